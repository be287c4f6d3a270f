"""Verdicts and classes of scored pairs, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmere.functions.strings import is_combosquat

# Labels and sentences.
TAGS = {"identical": "IDENTICAL", "same_project": "SAME PROJECT", "likely_typosquat": "LIKELY TYPOSQUAT", "possible_combosquat": "POSSIBLE COMBOSQUAT", "unrelated": "UNRELATED"}
ALERTS = ("likely_typosquat", "possible_combosquat")
IDENTICAL = "The strings are identical."
SAME_PROJECT = "The names differ only by registry normalization (same project)."
LOOKALIKE = "Strings differ but share a confusable skeleton (visual lookalike)."
ONE_EDIT = "1 Damerau edit."
NEAR_KEYS = " Keyboard distance 0 (no far-key substitutions)."
COMBOSQUAT = "One name is the other plus a delimited affix (possible combosquat)."
UNRELATED = "No typosquat signal (damerau > 1 and not confusable-only)."
ALL_HOMOGLYPHS = "every differing character is a homoglyph (the strings are visually identical)"
MOST_HOMOGLYPHS = "most of the difference comes from homoglyphs (visually confusable characters)"
DIFFER, EDIT, EDITS = "The strings differ by ", "1 edit", " edits"
BUT, CONFUSE = ", but ", ". High likelihood of an attempt to confuse."
NOT_HOMOGLYPHS = " with no significant homoglyph involvement"
MINOR = " (with only minor homoglyph involvement)"
TYPO, UNLIKE = " — likely a typo.", " — they appear unrelated."


def classified(identical: Column, same: Column, a: Column, b: Column, damerau: Column, confusable_only: Column, keyboard: Column) -> tuple[Column, Column]:
    """Class and reason; a, b are the scored strings. Null strings give null."""
    likely = (confusable_only | (damerau <= 1)) & (F.greatest(F.length(a), F.length(b)) >= 3)
    combo = is_combosquat(a, b)
    known = a.isNotNull() & b.isNotNull()
    edit = F.concat(F.lit(ONE_EDIT), F.when(F.abs(keyboard) < 1e-12, NEAR_KEYS).otherwise(""))
    label = F.when(~known, None).when(identical, "identical").when(same, "same_project").when(likely, "likely_typosquat").when(combo, "possible_combosquat").otherwise("unrelated")
    reason = F.when(~known, None).when(identical, IDENTICAL).when(same, SAME_PROJECT).when(likely, F.when(confusable_only, LOOKALIKE).otherwise(edit)).when(combo, COMBOSQUAT).otherwise(UNRELATED)
    return label, reason


def verdict(a: Column, b: Column, equal: Column, damerau: Column, skeleton_damerau: Column, delta: Column, confusable_only: Column, same: Column | None = None, len_tolerance: float = 0.25) -> tuple[Column, Column]:
    """Verdict and explanation; a, b are the original strings, whatever was scored."""
    la, lb = F.length(a), F.length(b)
    longest = F.greatest(la, lb)
    share = F.when(damerau == 0, 0.0).otherwise(delta / damerau)
    spoof = confusable_only | ((share > 0.5) & (longest >= 3) & (F.abs(la - lb) / F.greatest(longest, F.lit(1)) <= len_tolerance))
    edits = F.when(damerau == 1, EDIT).otherwise(F.concat(damerau.cast("string"), F.lit(EDITS)))
    detail = F.when(confusable_only, ALL_HOMOGLYPHS).otherwise(MOST_HOMOGLYPHS)
    spoofed = F.concat(F.lit(DIFFER), edits, F.lit(BUT), detail, F.lit(CONFUSE))
    note = F.when(skeleton_damerau < damerau, MINOR).otherwise("")
    ending = F.when(damerau <= 2, F.concat(note, F.lit(TYPO))).otherwise(UNLIKE)
    benign = F.concat(F.lit(DIFFER), edits, F.lit(NOT_HOMOGLYPHS), ending)
    same = F.lit(False) if same is None else same
    known = a.isNotNull() & b.isNotNull()
    label = F.when(~known, None).when(same, "SAME PROJECT").when(equal, "IDENTICAL").when(spoof, "LIKELY SPOOF").otherwise("LIKELY BENIGN")
    why = F.when(~known, None).when(same, SAME_PROJECT).when(equal, IDENTICAL).when(spoof, spoofed).otherwise(benign)
    return label, why
