"""Text functions as Catalyst column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuelight.functions import lexicon as lx


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(text) -> Column:
    """Without white space at either end: blanks, tabs, line ends and feeds."""
    return F.btrim(_c(text), F.lit(lx.WHITE))


def _lits(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def tokenize(text) -> Column:
    """Lower-case tokens of letters, digits and underscores; a lone underscore is no token."""
    return F.array_remove(tokenize_words(text), "_")


def tokenize_words(text) -> Column:
    """All runs of word characters, a lone underscore included."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(f"({lx.WORD}+)"), F.lit(1))


def drop_stopwords(tokens) -> Column:
    """Without stopwords, unless nothing else is there. Repeated tokens stay."""
    tokens = _c(tokens)
    kept = F.filter(tokens, lambda t: ~t.isin(lx.STOPWORDS))
    return F.when(F.size(kept) == 0, tokens).otherwise(kept)


def clean_query(text) -> Column:
    out = strip(_c(text))
    for pattern in lx.QUERY_BOILERPLATE:
        out = strip(F.regexp_replace(out, "(?iuU)" + pattern, ""))
    return out


def dictionary_translate(text) -> Column:
    """English words of all dictionary keys that the query contains; the query itself if none."""
    lowered = F.lower(_c(text))
    hits = F.filter(
        F.array(*[F.when(F.contains(lowered, F.lit(k)), F.lit(v)) for k, v in lx.PHRASE_DICTIONARY]),
        lambda w: w.isNotNull(),
    )
    return F.when(F.size(hits) > 0, F.array_join(hits, " ")).otherwise(_c(text))


def prompts(text) -> Column:
    """The prompt ensemble of a query; one empty prompt for an empty query."""
    text = F.coalesce(_c(text), F.lit(""))
    filled = F.array(*[
        F.concat(*[p for p in (F.lit(a), text, F.lit(b))])
        for a, b in (t.split("{}") for t in lx.PROMPT_TEMPLATES)
    ])
    return F.when(text == "", F.array(F.lit(""))).otherwise(filled)


def subscenes(text) -> Column:
    """Scene descriptions inside a query: parts of at least 12 characters between separators."""
    joints = "|".join(lx.SCENE_CONNECTIVES)
    parts = F.split(_c(text), rf"(?iuU)[.\n;]|\b(?:{joints})\b")
    trimmed = F.transform(parts, lambda p: strip(F.regexp_replace(p, r"^[,:;\-\s]+|[,:;\-\s]+$", "")))
    return F.filter(trimmed, lambda p: (F.length(p) >= 12) & ~F.lower(p).isin(lx.SCENE_STOP_PHRASES))


def intent(text) -> Column:
    """struct(category, label, w_dense, w_speech, w_ocr, confidence) of the first rule that fires."""
    raw, lowered = _c(text), F.lower(_c(text))
    names = ("category", "label", "w_dense", "w_speech", "w_ocr", "confidence")

    def row(rule):
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(names, lx.INTENTS[rule])])

    return (
        F.when(raw.rlike(lx.QUOTED), row("quoted"))
        .when(lowered.rlike(lx.whole_word(lx.OCR_CUES)), row("ocr"))
        .when(lowered.rlike(lx.whole_word(lx.SPEECH_CUES)), row("speech"))
        .when(lowered.rlike(lx.whole_word(lx.VISUAL_CUES)), row("visual"))
        .otherwise(row("balanced"))
    )


def query_mode(filename, prompt) -> Column:
    fn = F.lower(F.coalesce(_c(filename), F.lit("")))
    pt = F.lower(F.coalesce(_c(prompt), F.lit("")))
    out = None
    for m in lx.MODES:
        marked = fn.contains(f"-{m}") | fn.contains(f"_{m}") | fn.contains(f"/{m}/")
        for ext in ("txt", "csv", "json"):
            marked = marked | fn.endswith(f"{m}.{ext}")
        out = F.when(marked, m) if out is None else out.when(marked, m)
    for m, cues in lx.MODE_PROMPT_CUES.items():
        out = out.when(pt.rlike("|".join(re.escape(c) for c in cues)), m)
    return out.otherwise("kis")


def query_id(path) -> Column:
    """Base name without extension, blanks as underscores, a mode folder as prefix."""
    parts = F.filter(
        F.split(F.translate(_c(path), "\\", "/"), "/"),
        lambda p: ~p.isin("", ".") & ~p.startswith("__MACOSX"),
    )
    base = F.regexp_replace(F.element_at(parts, -1), r"\.[^/.]+$", "")
    parent = F.lower(F.when(F.size(parts) > 1, F.element_at(parts, -2)))
    named = F.when(
        parent.isin(lx.MODES) & ~F.contains(F.lower(base), parent), F.concat_ws("-", parent, base)
    ).otherwise(base)
    return F.regexp_replace(named, r"\s+", "_")


def base_name(path) -> Column:
    return F.substring_index(strip(_c(path).cast("string")), "/", -1)


def safe_video_id(path) -> Column:
    """Base name without anything but ASCII letters, digits, underscore and hyphen."""
    return F.coalesce(F.regexp_replace(base_name(path), r"[^a-zA-Z0-9_\-]", ""), F.lit(""))


def file_stem(path) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def csv_field(value, max_len: int = 100) -> Column:
    flat = strip(F.translate(F.coalesce(_c(value), F.lit("")), "\r\n", "  "))
    cut = F.substring(flat, 1, max_len)
    quoted = F.concat(F.lit('"'), F.replace(cut, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(cut.rlike('[,"]'), quoted).otherwise(cut)


def segment_text(refined, cleaned, text) -> Column:
    """First of the three that is present, trimmed."""
    return strip(F.coalesce(_c(refined), _c(cleaned), _c(text), F.lit("")))


def segment_start(start_sec, start) -> Column:
    return F.coalesce(_c(start_sec), _c(start), F.lit(0.0))


def segment_end(end_sec, end, start) -> Column:
    return F.coalesce(_c(end_sec), _c(end), _c(start) + 1.0)


def frame_of(seconds, fps: float | Column = 25.0) -> Column:
    """Nearest frame; halves go to the even frame."""
    fps = F.lit(fps) if isinstance(fps, (int, float)) else fps
    return F.bround(_c(seconds) * fps, 0).cast("bigint")


def token_estimate(text) -> Column:
    words = word_count(text)
    return (F.floor(words * F.lit(1.35)) + 10).cast("bigint")


def word_count(text) -> Column:
    return F.regexp_count(_c(text), F.lit(r"\S+")).cast("bigint")


def strip_banned_prefixes(text) -> Column:
    """Without the banned prefixes, one after the other; null when under six characters to begin with."""
    raw = strip(_c(text))
    out = raw
    for prefix in lx.BANNED_PREFIXES:
        rest = F.regexp_replace(F.substring(out, len(prefix) + 1, 1 << 30), r"^[ :,.\-]+|[ :,.\-]+$", "")
        out = F.when(F.startswith(F.lower(out), F.lit(prefix)), rest).otherwise(out)
    return F.when(F.length(raw) >= 6, out)
