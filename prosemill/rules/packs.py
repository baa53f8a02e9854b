"""Rule packs as data: phrases, patterns, words and thresholds."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..functions.text import JA_DELIMITERS, LATIN_DELIMITERS


@dataclass(frozen=True)
class Pack:
    """The lexical rules of a language."""

    name: str
    delimiters: str
    phrases: tuple[str, ...]
    weak: tuple[str, ...] = ()
    calques: tuple[str, ...] = ()
    conjunctions: tuple[str, ...] = ()
    antithesis: tuple[str, ...] = ()
    inanimate: tuple[str, ...] = ()
    cleft: str = r"\A\z"
    because: str = r"\A\z"
    boilerplate: tuple[str, ...] = ()
    phase: str = r"\A\z"


# Fixed values of the Japanese rules.
JA = Pack(
    "ja",
    JA_DELIMITERS,
    phrases=(
        "と言えるでしょう", "と言えるだろう", "と言えます", "ということになるでしょう", "のではないでしょうか", "重要なのは", "大切なのは", "ポイントは", "結論から言うと", "結論として", "いかがでしたか", "いかがでしょうか",
        "まとめると", "総じて", "非常に重要", "極めて重要", "言うまでもなく", "言うまでもありません", "まさしく", "さて、", "それでは、", "このように", "このような中", "ここで注目したいのは", "見ていきましょう", "紹介していきます",
        "解説していきます", "深掘りしていきます", "一概には言えません", "個人差がありますが", "あくまで一例ですが", "正面から扱う", "正面から見る", "正面から書く", "正面から立てる", "正面から回収する", "不可欠", "核心的", "鍵となる",
        "根本的な", "多角的", "包括的", "総合的", "掘り下げる", "深掘りする", "言語化する", "について見ていく", "を探求する",
    ),
    weak=("重要なのは", "このように", "不可欠", "ポイントは", "さて、"),
    calques=(
        "することができ(る|ます|た)", "することが可能(です|だ|になる)", "と言えるだろう", "という点で", "という観点(から|で)", "にとって(重要|不可欠)", "を持つ(こと|存在)", "することによって", "であることは間違いない", "に他ならない",
    ),
    conjunctions=("しかし", "また", "そして", "そのため", "さらに", "つまり", "一方", "一方で", "このように", "なぜなら", "したがって", "ただし"),
    antithesis=("ではなく、?.{0,30}", "だけでなく.{0,10}も"),
    inanimate=("(これ|それ|この事実|そのこと)(は|が).{0,40}(もたらす|示す|意味する|証明する|生み出す|反映する)", ".{0,20}(こと|事実)(は|が).{0,40}(もたらす|示す|意味する|証明する|生み出す|反映する)"),
    cleft="^(それ|これ|この)は.{0,60}(である|だ)$",
    because="^(なぜなら|というのも)",
    boilerplate=("まとめ", "おわりに", "終わりに", "さいごに", "最後に", "結論", "総括", "conclusion"),
    phase="(フェーズ|ステップ|段階|ステージ)\\s*[0-9１-９]",
)

#: Rules of the same kinds for Latin-script text.
LATIN = Pack(
    "latin",
    LATIN_DELIMITERS,
    phrases=("licensed under", "Licensed under", "the of", "of the", "in the", "de la", "que la", "der die", "in order to", "click here"),
    weak=("of the", "in the"),
    calques=("able to (the|a)", "(is|was) (of|that)", "pour (la|le)", "mit (der|dem)"),
    conjunctions=("And", "But", "For", "With", "Et", "Und", "Que"),
    antithesis=("not only .{0,30}", "on the .{0,20}", "de la .{0,20}"),
    inanimate=("(This|That|It) (is|was) .{0,40}(the|of)",),
    cleft="^(It|This|That|The) .{0,60}(the|of|and)$",
    because="^(For|From|And)",
    boilerplate=("conclusion", "summary"),
    phase="(phase|step|stage|src)\\s*[0-9]",
)
PACKS = {p.name: p for p in (JA, LATIN)}

# Headings by template, in the order in which they are tried.
TEMPLATE_HEADINGS = ("はじめに", "背景", "概要", "本記事について", "この記事について", "まとめと今後", "今後の展望", "今後の課題", "今後について", "まとめ", "おわりに", "終わりに", "さいごに", "最後に", "結論", "総括", "conclusion", "introduction", "summary")

# Parts of speech and words of the morpheme rules.
TRAILING_POS = ("補助記号", "空白")
CONTENT_POS = ("名詞", "動詞", "形容詞", "副詞")
PRONOUNS = ("これ", "それ", "あれ", "それら")
PRONOUN_PHRASES = ("この事実", "そのこと")
FORMAL_NOUNS = ("こと", "事実", "の")
SMELL_VERBS = ("もたらす", "示す", "意味する", "証明する", "生み出す", "反映する", "示唆する", "物語る", "浮き彫りにする", "後押しする")
ABSTRACT_NOUNS = ("側面", "観点", "重要性", "可能性", "あり方", "存在", "意味", "本質", "価値", "意義", "課題", "問題", "要素", "要因", "背景", "傾向", "姿勢", "視点", "概念", "特徴", "性質", "状況", "状態", "変化")
EXAMPLE_MARKERS = ("たとえば", "例えば", "実際に", "実際には", "具体的には", "具体例として", "一例として", "先日", "昨日", "現に", "実例として")
NUMERIC_QUANTITY = "[0-9０-９]+(年代|年間|世紀|年|月|日|時間|時|分|秒|人|円|%|％|kg|km|cm|mm|g|m|回|件|個|つ|割|倍|台|社|名|冊|本|杯|軒)?"
EMOJI = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2B50}\\x{2705}\\x{274C}\\x{2757}\\x{2753}]"


@dataclass(frozen=True)
class Profile:
    """Thresholds; the fields' values are the fixed defaults of the rules."""

    genre: str | None = None
    disabled: frozenset[str] = frozenset()
    antithesis_min: int = 3
    antithesis_info_below: float = 0.02
    antithesis_critical_from: float = 0.03
    variance_min_sentences: int = 5
    variance_cv: float = 0.25
    nominal_min_sentences: int = 5
    nominal_ratio: float = 0.0
    nominal_min_chars: int = 2000
    conjunction_min_paragraphs: int = 3
    conjunction_ratio: float = 0.3
    uniform_min_paragraphs: int = 4
    uniform_cv: float = 0.15
    burstiness_min: int = 6
    burstiness: float = -0.24
    autocorrelation_min: int = 4
    autocorrelation: float = 0.6
    lead_repeat: int = 6
    template_min: int = 6
    template_ratio: float = 0.4
    diversity_min_tokens: int = 30
    ttr: float = 0.45
    mtld: float = 40.0
    diversity_min_chars: int = 4000
    specificity_min_chars: int = 80
    specificity_min_words: int = 15
    proper_weight: float = 1.0
    numeric_weight: float = 1.0
    example_bonus: float = 0.1
    abstract_weight: float = 1.5
    specificity: float = -0.15
    bold_min: int = 3
    bold_per_1000: float = 3.0
    bullet_min_lines: int = 10
    bullet_ratio: float = 0.35
    phase_min: int = 3
    emoji_min: int = 3
    emoji_per_1000: float = 2.0
    semantic_min_sentences: int = 10
    flatness: float = 0.16123
    repetition_max: float = 0.93222
    topic_jump: float = 0.76576


DEFAULT = Profile()
#: Overrides by genre.
PROFILES = {
    None: DEFAULT,
    "essay": replace(DEFAULT, genre="essay", nominal_min_chars=1500, lead_repeat=5, flatness=0.15813),
    "tech": replace(DEFAULT, genre="tech", nominal_min_chars=3000, lead_repeat=7, antithesis_critical_from=0.045, flatness=0.14262),
    "business": replace(DEFAULT, genre="business", nominal_min_chars=3000, lead_repeat=7, flatness=0.15566, disabled=frozenset({"high_bullet_ratio", "high_bold_density", "boilerplate_heading", "numbered_phase_structure"})),
}
#: Categories shown only on request.
EXPERIMENTAL = frozenset({"paragraph_lead_conjunction", "high_length_autocorrelation", "repeated_syntax_template", "english_syntax_cleft_because", "high_bold_density", "high_bullet_ratio", "boilerplate_heading", "numbered_phase_structure", "high_emoji_symbol_density"})

