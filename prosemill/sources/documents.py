"""Corpus sources and sinks: text files, metadata, front matter, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Genres by file-name prefix; a parameter wherever they are used.
GENRE_PREFIXES = ("blog", "tech", "business", "essay", "note")
SOURCES = "id string, type string, url string, title string, author string, genre string, register string, quality string, published string, ai_era_risk boolean, notes string"


def dealt_out(scan: DataFrame) -> DataFrame:
    """A scan with at least as many partitions as the session has cores, for expensive work on its rows.

    A file of one row group is one task however many cores there are. Tables of
    enough splits, as all large ones, are left alone, so nothing large is shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_texts(spark: SparkSession, path: str, glob: str = "*.{md,txt}") -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of text files below ``path``: a missing path and files that are no UTF-8 or blank go to the errors."""
    if not exists(spark, path):
        none = spark.createDataFrame([], "path string, doc_id string, text string")
        return none, spark.createDataFrame([(path, "missing")], "path string, error string")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    rows = raw.select("path", name.alias("doc_id"), text.alias("text"))
    blank = F.col("text").rlike(r"\A(?U)\s*\z")
    good = rows.filter(F.col("text").isNotNull() & ~blank)
    bad = rows.filter(F.col("text").isNull() | blank).select("path", F.when(F.col("text").isNull(), "not UTF-8").otherwise("blank").alias("error"))
    return good, bad


def read_sources(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Metadata of a corpus, a JSON array."""
    out = spark.read.schema(SOURCES).json(path, multiLine=True)
    return out if kind is None else out.filter(F.col("type") == kind)


def genre_of(name: Column, prefixes: tuple[str, ...] = GENRE_PREFIXES) -> Column:
    out = F.lit("unknown")
    for p in reversed(prefixes):
        out = F.when(name.startswith(p), p).otherwise(out)
    return out


def grouped_corpus(docs: DataFrame, sources: DataFrame, prefixes: tuple[str, ...] = GENRE_PREFIXES) -> DataFrame:
    """Documents with group (fp_base, reference, ai), genre, model and length.

    Machine texts lie in a folder named after their model, below one named ai;
    human texts are trusted by quality or register.
    """
    parts = F.split("path", "/")
    is_ai = F.array_contains(parts, "ai")
    bare_id = F.regexp_replace("doc_id", "^aozora-", "")
    meta = sources.select(F.regexp_replace("id", "^aozora-", "").alias("__id"), F.col("genre").alias("__genre"), "quality", "register", "ai_era_risk")
    joined = docs.withColumn("__id", bare_id).join(meta, "__id", "left")
    trusted = (F.col("quality") == "high") | (F.col("register") == "modern-colloquial-classic")
    group = F.when(is_ai, "ai").when(F.coalesce(trusted, F.lit(False)), "fp_base").otherwise("reference")
    return joined.select("doc_id", "text", group.alias("grp"), F.when(is_ai, genre_of(F.col("doc_id"), prefixes)).otherwise(F.coalesce("__genre", F.lit("unknown"))).alias("genre"), F.when(is_ai, F.element_at(parts, -2)).alias("model"), "quality", "register", "ai_era_risk", F.length("text").alias("n_chars"))


def _placed(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with ``place`` (ai, aozora, web or none of these folders), ``model`` and what the metadata say of their id."""
    parts = F.split("path", "/")
    place = F.when(F.array_contains(parts, "ai"), "ai").when(F.array_contains(parts, "aozora"), "aozora").when(F.array_contains(parts, "web"), "web")
    meta = sources.select(F.col("id").alias("__id"), F.col("genre").alias("__genre"), "quality", "register", "ai_era_risk").dropDuplicates(["__id"])
    out = docs.withColumn("place", place).join(meta, F.col("doc_id") == F.col("__id"), "left")
    return out.filter("place is not null").withColumn("model", F.when(F.col("place") == "ai", F.element_at(parts, -2)))


def calibration_groups(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """A row per document and group it is in: human_aozora, human_web or ai, and beside it human_business or ai_business."""
    business = F.when(F.col("place") == "ai", F.col("doc_id").startswith("business-")).when(F.col("place") == "web", F.col("__genre") == "business")
    own = F.when(F.col("place") == "ai", "ai").otherwise(F.concat(F.lit("human_"), F.col("place")))
    beside = F.when(business, F.when(F.col("place") == "ai", "ai_business").otherwise("human_business"))
    return _placed(docs, sources).select("doc_id", "text", F.explode(F.array_compact(F.array(own, beside))).alias("grp"))


#: Genres by file-name prefix of machine texts whose perplexity is measured.
PERPLEXITY_PREFIXES = ("blog", "business", "essay", "slide", "tech")


def perplexity_buckets(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with bucket (human_high, human_ordinary or ai:model), genre and model."""
    ai = F.col("place") == "ai"
    high = F.when(F.col("place") == "web", F.col("quality") == "high").otherwise(F.col("register") == "modern-colloquial-classic")
    bucket = F.when(ai, F.concat(F.lit("ai:"), F.col("model"))).when(F.coalesce(high, F.lit(False)), "human_high").otherwise("human_ordinary")
    prefix = F.get(F.filter(F.array(*[F.lit(p) for p in PERPLEXITY_PREFIXES]), lambda p: F.startswith(F.col("doc_id"), F.concat(p, F.lit("-")))), F.lit(0))
    genre = F.when(ai, F.coalesce(prefix, F.lit("unknown"))).when(F.col("place") == "aozora", "essay").otherwise(F.coalesce("__genre", F.lit("unknown")))
    return _placed(docs, sources).select("doc_id", "text", bucket.alias("bucket"), genre.alias("genre"), "model")


def rhythm_humans(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Human documents for rhythm: web texts of high quality without risk of machine writing, and colloquial classics, with genre."""
    web = (F.col("place") == "web") & (F.col("quality") == "high") & ~F.coalesce("ai_era_risk", F.lit(False))
    classic = (F.col("place") == "aozora") & (F.col("register") == "modern-colloquial-classic")
    kept = _placed(docs, sources).filter(F.coalesce(web | classic, F.lit(False)))
    return kept.select("doc_id", "text", F.when(F.col("place") == "aozora", "essay").otherwise(F.coalesce("__genre", F.lit("unknown"))).alias("genre"))


def classifier_rows(docs: DataFrame, sources: DataFrame, prefixes: tuple[str, ...] = GENRE_PREFIXES) -> DataFrame:
    """Documents with group (human or ai), model_or_source, genre and quality; ids are made of the folder and the file."""
    ai, aozora = F.col("place") == "ai", F.col("place") == "aozora"
    name = F.when(ai, F.concat(F.lit("ai/"), F.col("model"), F.lit("/"))).otherwise(F.concat(F.lit("human_"), F.col("place"), F.lit("/")))
    genre = F.when(ai, genre_of(F.col("doc_id"), prefixes)).otherwise(F.coalesce("__genre", F.when(aozora, "essay").otherwise("unknown")))
    quality = F.when(ai, "n/a").when(aozora, F.when(F.coalesce(F.col("register") == "modern-colloquial-classic", F.lit(False)), "high").otherwise("other")).otherwise(F.coalesce("quality", F.lit("unknown")))
    return _placed(docs, sources).select(F.concat(name, "doc_id").alias("doc_id"), F.when(ai, "ai").otherwise("human").alias("grp"), F.coalesce("model", "place").alias("model_or_source"), genre.alias("genre"), quality.alias("quality"), "text")


def with_front_matter(df: DataFrame, fields: list[str], body: str = "text") -> Column:
    """A document with a header of ``fields`` between two rules."""
    head = [F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *head), F.lit("\n---\n\n"), F.col(body))


def front_matter(text: Column, field: str) -> Column:
    """A field of a document's header; null if there is none."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    return F.nullif(F.regexp_extract(head, rf"(?m)^{field}: *(.*)$", 1), F.lit(""))


def body_of(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n+", "")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; the first malformed one fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def numbered_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records, errors) of JSON-line files: every record and every malformed line with its file and line number.

    A file is numbered as a whole, in one task; result files of a study are small.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = files.select("path", F.posexplode(F.split("value", "\r?\n")).alias("k", "json")).filter(F.trim("json") != "").select("path", (F.col("k") + 1).alias("line"), "json")
    parsed = lines.withColumn("record", F.from_json("json", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("record._bad").isNotNull() | F.col("record").isNull()
    names = [f.name for f in parsed.schema["record"].dataType if f.name != "_bad"]
    return parsed.filter(~bad).select("path", "line", *[f"record.{c}" for c in names]), parsed.filter(bad).select("path", "line", F.concat("path", F.lit(":"), "line", F.lit(": malformed JSON")).alias("error"))


def not_yet_done(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` without a result, for incremental runs."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


#: A line of a page number.
PAGE_NUMBER = r"^[-‐―ー0-9０-９ページPage/\s.]{1,10}$"


def repeated_page_lines(pages: DataFrame, longest: int = 40) -> DataFrame:
    """From (doc_id, page, line_no, line): lines without running heads and page numbers.

    A short line on at least max(3, half) of a document's pages, of more than two, is a running head.
    """
    text = F.trim("line")
    total = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    seen = pages.filter((F.length(text) <= longest) & (text != "")).groupBy("doc_id", text.alias("t")).agg(F.count_distinct("page").alias("on"))
    heads = seen.join(total, "doc_id").filter("pages > 2 and on >= greatest(3, pages div 2)").select("doc_id", "t")
    left = pages.withColumn("t", text).join(heads, ["doc_id", "t"], "left_anti")
    return left.filter((F.col("t") != "") & ~F.col("t").rlike(PAGE_NUMBER)).select("doc_id", "page", "line_no", F.col("t").alias("line"))


def markdown_table(df: DataFrame) -> str:
    """A report's table as Markdown, whole; for results, not data."""
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    return head + "\n".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.toLocalIterator())
