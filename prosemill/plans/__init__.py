"""Plans that join operators into passes."""
