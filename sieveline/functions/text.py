"""Cleaning, labels, views and keys as native column expressions."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values ----
CLASS_ORDER = ("ham", "spam", "smishing")
HAM_WORDS = ("ham", "legitimate", "benign")
SPAM_WORDS = ("spam", "promotional", "marketing")
SMISHING_WORDS = ("smishing", "phishing", "malicious", "fraud")
TRUE_WORDS = ("1", "true", "yes")
FALSE_WORDS = ("0", "false", "no")
MAX_MESSAGE_CHARS = 1600
EMAIL_PHRASES = (
    "this email was sent",
    "click here to unsubscribe",
    "view email in browser",
    "forwarded message",
    "to view this email as a web page",
    "copyright ©",
    "all rights reserved",
)
#: Language names and three-letter codes that libraries use, by two-letter code.
LANGUAGES = {
    "en": ("english", "eng"),
    "es": ("spanish", "castilian", "spa"),
    "fr": ("french", "fra", "fre"),
    "de": ("german", "deu", "ger"),
    "it": ("italian", "ita"),
    "pt": ("portuguese", "por"),
    "nl": ("dutch", "flemish", "nld", "dut"),
    "ru": ("russian", "rus"),
    "zh": ("chinese", "zho", "chi"),
    "ja": ("japanese", "jpn"),
    "ko": ("korean", "kor"),
    "ar": ("arabic", "ara"),
    "hi": ("hindi", "hin"),
    "bn": ("bengali", "bangla", "ben"),
    "tr": ("turkish", "tur"),
    "pl": ("polish", "pol"),
    "sv": ("swedish", "swe"),
    "da": ("danish", "dan"),
    "no": ("norwegian", "nor"),
    "fi": ("finnish", "fin"),
    "id": ("indonesian", "ind"),
    "uk": ("ukrainian", "ukr"),
    "vi": ("vietnamese", "vie"),
    "ro": ("romanian", "moldavian", "ron", "rum"),
    "cs": ("czech", "ces", "cze"),
    "el": ("modern greek (1453-)", "ell", "gre"),
    "he": ("hebrew", "heb"),
    "th": ("thai", "tha"),
    "ur": ("urdu", "urd"),
    "ca": ("catalan", "valencian", "cat"),
}
#: (pattern, what stands for it), in order.
VIEW_STEPS = (
    (r"<\s*([A-Z_][A-Z0-9_]*)\s*>", " $1_token "),
    (r"(?i)https?://\S+|www\.\S+", " url_token "),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", " email_address_token "),
    (r"\+?\d[\d\s-]{6,}\d", " phone_number_token "),
    (r"\b\d{4,}\b", " number_token "),
)
#: Rules of two binary columns, as they are named: smishing, spam, its opposite, neither.
PRIORITY_RULES = ("smishing_label==1->smishing", "spam_label==1->spam", "spam_label==0->ham", "else->unlabeled")
# ---- end of fixed values ----

#: White space as Unicode has it, with the four separators that count as such in the source texts.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, with c worked out once however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """df with columns that are worked out once: a plain column would be repeated wherever a later step names it."""
    names = list(columns)
    (holder,) = free(df, "_once")
    held = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names], held.alias(holder)).withColumns({n: F.col(holder)[n] for n in names}).drop(holder)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each behind as many underscores as it takes to differ from df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def clean_str(c: Column) -> Column:
    """White space runs become one space, ends are trimmed; nothing left is null."""
    return F.nullif(collapse(c.cast("string")), F.lit(""))


def _word(c: Column) -> Column:
    return F.lower(collapse(c.cast("string")))


def map_label_basic(c: Column) -> Column:
    w = _word(c)
    return F.when(w.isin(*HAM_WORDS), "ham").when(w.isin(*SPAM_WORDS), "spam").when(w.isin(*SMISHING_WORDS), "smishing")


def map_binary_label(c: Column, positive: str) -> Column:
    w = _word(c)
    return F.when(w.isin(*TRUE_WORDS), positive).when(w.isin(*FALSE_WORDS), "ham")


def label_priority(spam: Column, smishing: Column) -> tuple[Column, Column]:
    """(label, rule) of two binary columns: smishing first, then spam, then its explicit opposite; else unlabeled."""
    spam, smishing = F.trim(F.coalesce(spam, F.lit(""))), F.trim(F.coalesce(smishing, F.lit("")))
    label = F.when(smishing == "1", "smishing").when(spam == "1", "spam").when(spam == "0", "ham")
    first, second, third, none = PRIORITY_RULES
    rule = F.when(smishing == "1", first).when(spam == "1", second).when(spam == "0", third).otherwise(none)
    return label, rule


@functools.cache
def language_names() -> dict[str, str]:
    """Two-letter code by English name and by three-letter code, for every language that Java's locales know, and by the names and codes that libraries use besides."""
    out: dict[str, str] = {}
    jvm = SparkSession.getActiveSession().sparkContext._jvm
    locale = jvm.java.util.Locale
    for code in locale.getISOLanguages():
        own = locale.forLanguageTag(code)
        out[own.getDisplayLanguage(locale.ENGLISH).lower()] = code
        out[own.getISO3Language().lower()] = code
    return out | {name: code for code, names in LANGUAGES.items() for name in names}


def normalize_language(c: Column) -> Column:
    """Two letters pass; known names and three-letter codes become two; anything else is lower-cased."""
    w = F.nullif(F.lower(F.trim(c)), F.lit(""))
    known = F.create_map(*[F.lit(x) for pair in language_names().items() for x in pair])
    return F.when(F.length(w) == 2, w).otherwise(F.coalesce(F.try_element_at(known, w), w))


def iso_from_epoch_ms(c: Column) -> Column:
    return F.date_format(F.timestamp_millis(c.try_cast("bigint")), "yyyy-MM-dd HH:mm:ss")


def mapping_rule(rule: Column, original: Column, label: Column) -> Column:
    """The loader's rule, else original->label where there is a label, else empty; lower-cased."""
    named = F.coalesce(F.nullif(rule, F.lit("")), F.when(F.coalesce(label, F.lit("")) != "", F.concat(F.coalesce(original, F.lit("unlabeled")), F.lit("->"), label)), F.lit(""))
    return F.lower(F.trim(named))


def normalized_name(c: Column) -> Column:
    """References and licences: lower-cased, `unknown` by default."""
    return F.lower(F.trim(F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))))


def message_id(reference: Column, source_id: Column, text: Column) -> Column:
    """A stable id, so that a second run names the same message alike."""
    return F.concat(F.lit("msg_"), F.substring(F.sha2(F.concat_ws("|", reference, source_id, text), 256), 1, 12))


def format_confidence(c: Column) -> Column:
    """Two digits, half to even; empty when 0 or null."""
    return F.when(F.coalesce(c, F.lit(0.0)) == 0, "").otherwise(F.format_string("%.2f", F.bround(c, 2)))


def sanitize_token(c: Column) -> Column:
    safe = F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("na"))


def ai_flag(c: Column) -> Column:
    return F.coalesce(c.try_cast("double").cast("int"), F.lit(0))


def is_valid_message(c: Column) -> Column:
    """Not empty, not longer than a message can be, and without the phrases of mails."""

    def mail(low: Column) -> Column:
        out = F.lit(False)
        for phrase in EMAIL_PHRASES:
            out = out | F.contains(low, F.lit(phrase))
        return out

    short = lambda x: (F.length(x) > 0) & (F.length(x) <= MAX_MESSAGE_CHARS) & ~bound(F.lower(x), mail)
    return F.coalesce(bound(c, short), F.lit(False))


def is_pre_anonymized(raw: Column) -> Column:
    return F.coalesce(F.rlike(raw, F.lit("<[A-Z0-9_]+>")), F.lit(False))


def anonymization_status(raw: Column, cleaned: Column, masked: Column) -> Column:
    return F.when(is_pre_anonymized(raw), "pre_anonymized").when(masked != cleaned, "anonymized").otherwise("raw")


def strip_control(c: Column) -> Column:
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def collapse_tokens(c: Column) -> Column:
    """Repeats of one angle token become one."""
    return F.regexp_replace(c, r"(?U)(<[a-zA-Z0-9_]+>)(?:\s*\1)+", "$1")


def folded_key(c: Column) -> Column:
    """SHA-256 of the text in lower case with single spaces; empty for empty."""
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.sha2(collapse(F.lower(c)), 256))


def normalize_text(c: Column) -> Column:
    """The view for vectorisers: tokens for links, mails, phones and numbers, lower case, single spaces."""
    s = F.coalesce(c, F.lit(""))
    for pattern, to in VIEW_STEPS:
        s = F.regexp_replace(s, pattern, to)
    return collapse(F.lower(s))


def injected_text(urgency: Column, theme: Column, norm: Column) -> Column:
    return F.concat(F.lit("[URGENCIA: "), F.coalesce(urgency, F.lit("Desconocida")), F.lit("] [TEMA: "), F.coalesce(theme, F.lit("General")), F.lit("] "), norm)


VIEWS = ("raw", "anonymized", "norm", "injected")


def view_columns(df: DataFrame, view: str = "norm") -> tuple[Column, str]:
    """(text, view) of a master table for models: an unknown view is norm, a missing column the next that there is."""
    view = view if view in VIEWS else "norm"
    raw = F.coalesce(F.col("text_raw" if "text_raw" in df.columns else "text"), F.lit(""))
    anonymized = F.coalesce(F.col("text_anonymized"), F.lit("")) if "text_anonymized" in df.columns else raw
    norm = normalize_text(anonymized)
    told = {"urgency_level", "theme"} <= set(df.columns)
    injected = injected_text(F.nullif(F.col("urgency_level"), F.lit("")), F.nullif(F.col("theme"), F.lit("")), norm) if told else norm
    return {"raw": raw, "anonymized": anonymized, "norm": norm, "injected": injected}[view], view


def with_view(df: DataFrame, view: str = "norm") -> DataFrame:
    """Labelled rows of a master table with text_view, the text that a model sees; rows without a known label or with an empty text go."""
    label = F.lower(F.trim("canonical_label"))
    rows = df.filter(F.col("canonical_label").isin(*CLASS_ORDER)).withColumn("canonical_label", label)
    return once(rows, {"text_view": view_columns(df, view)[0]}).filter(F.length("text_view") > 0)


def label_id(c: Column) -> Column:
    """The place in CLASS_ORDER; null outside."""
    return F.nullif(F.array_position(F.array(*map(F.lit, CLASS_ORDER)), c) - 1, F.lit(-1)).cast("int")


def word_tokens(c: Column) -> Column:
    """Words of two and more characters, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def ngrams(words: Column) -> Column:
    """Single words, then neighbours joined by a space."""
    pairs = F.transform(words, lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
    return F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))
