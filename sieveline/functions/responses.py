"""What language models answer, as labels and annotations; and the prompts they get."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CLASS_ORDER

# ---- fixed values ----
THEMES = (
    "personal", "family_emergency", "banking", "delivery",
    "account_security", "tech_support", "promotion", "survey",
    "government", "job_offer", "dating_adult", "subscription",
    "service_alert", "unknown",
)
URGENCY_LEVELS = ("none", "low", "medium", "high")
LEAST_CONFIDENCE = 0.60
#: The five ways of asking: name, examples, persona, reasoning.
PROMPTS = (
    ("zero-shot_basic_direct", "zero-shot", "basic", "direct"),
    ("zero-shot_expert_direct", "zero-shot", "expert", "direct"),
    ("zero-shot_expert_cot", "zero-shot", "expert", "cot"),
    ("few-shot_expert_cot", "few-shot", "expert", "cot"),
    ("dynamic-few-shot_expert_cot", "dynamic-few-shot", "expert", "cot"),
)
#: What stands around a message and its examples.
MESSAGE, EXAMPLE, LABEL = "Message: ", "Example Message: ", "Label: "
BEFORE_EXAMPLES = "Here are some examples of messages and their correct labels:"
BEFORE_MESSAGE = "Now classify the following message:"
# ---- end of fixed values ----


def plain_response(c: Column) -> Column:
    """Without reasoning blocks and code fences."""
    s = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<think>.*?</think>", ""))
    s = F.trim(F.replace(s, F.lit("<think>"), F.lit("")))
    s = F.regexp_replace(s, r"^```json", "")
    s = F.regexp_replace(F.regexp_replace(s, r"^```", ""), r"```$", "")
    return F.trim(s)


def label_of_response(c: Column) -> Column:
    """The label of a JSON answer; else the first class that is named, the most harmful first; else ham."""
    s = plain_response(c)
    said = F.lower(F.trim(F.get_json_object(s, "$.label")))
    low = F.lower(s)
    named = F.when(F.contains(low, F.lit("smishing")), "smishing").when(F.contains(low, F.lit("spam")), "spam").otherwise("ham")
    return F.when(said.isin(*CLASS_ORDER), said).otherwise(named)


def annotation_json(c: Column) -> Column:
    """The JSON text of an annotation: the whole answer, or its widest span in braces; null if neither parses."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)<think>.*?</think>", "")
    s = F.regexp_replace(F.trim(F.regexp_replace(s, r"```(?:json)?\s*", "")), r"`+$", "")
    span = F.regexp_extract(s, r"(?s)(\{.*\})", 1)
    valid = lambda x: F.get_json_object(x, "$").isNotNull()
    return F.when(valid(F.trim(s)), F.trim(s)).when(valid(span), span)


def validated_annotation(theme: Column, urgency: Column, language: Column) -> tuple[Column, Column, Column]:
    fold = lambda x, d: F.lower(F.trim(F.coalesce(x, F.lit(d))))
    t, u = fold(theme, "unknown"), fold(urgency, "none")
    return F.when(t.isin(*THEMES), t).otherwise("unknown"), F.when(u.isin(*URGENCY_LEVELS), u).otherwise("none"), F.substring(fold(language, ""), 1, 2)


def override_language(language: Column, confidence: Column, annotated: Column) -> tuple[Column, Column]:
    """(language, confidence): a two-letter annotation replaces a detection that is unsure or unknown."""
    unsure = (F.coalesce(confidence.try_cast("double"), F.lit(0.0)) < LEAST_CONFIDENCE) | (F.coalesce(language, F.lit("unknown")) == "unknown")
    use = (F.length(F.coalesce(annotated, F.lit(""))) == 2) & unsure
    return F.when(use, annotated).otherwise(language), F.when(use, "LLM").otherwise(confidence.cast("string"))


def zero_shot_prompt(text: Column) -> Column:
    return F.concat(F.lit(MESSAGE), text, F.lit("\n"))


def few_shot_prompt(text: Column, examples: Column) -> Column:
    """examples: array of structs (text, label), in order."""
    shown = F.array_join(F.transform(examples, lambda e: F.concat(F.lit(EXAMPLE), e["text"], F.lit(f"\n{LABEL}"), e["label"], F.lit("\n\n"))), "")
    return F.concat(F.lit(f"{BEFORE_EXAMPLES}\n\n"), shown, F.lit(f"{BEFORE_MESSAGE}\n{MESSAGE}"), text, F.lit("\n"))


def prompt(name: str, text: Column, fixed: Column, near: Column) -> Column:
    """The whole prompt of one of PROMPTS: what the model is, then the message, with the fixed examples or the nearest ones (arrays of structs (text, label)) where the way of asking has any."""
    _, examples, persona, reasoning = next(p for p in PROMPTS if p[0] == name)
    asked = {"zero-shot": zero_shot_prompt(text), "few-shot": few_shot_prompt(text, fixed), "dynamic-few-shot": few_shot_prompt(text, near)}[examples]
    return F.concat(F.lit(system_prompt(persona, reasoning) + "\n\n"), asked)


def annotation_prompt(text: Column) -> Column:
    """Asks for theme, urgency and language of a message, out of the closed sets; our own wording."""
    asked = f'Read the text message and answer with a JSON object of three keys: "theme" (one of {", ".join(THEMES)}), "urgency_level" (one of {", ".join(URGENCY_LEVELS)}) and "language" (two letters). Write nothing else.'
    return F.concat(F.lit(asked + "\n\n"), zero_shot_prompt(text))


def annotation(response: Column) -> tuple[Column, Column, Column]:
    """(theme, urgency, language) of a model's answer; unknown, none and unknown where it can't be parsed."""
    j = annotation_json(response)
    said = lambda key, default: F.coalesce(F.get_json_object(j, f"$.{key}"), F.when(j.isNull(), default))
    return said("theme", "unknown"), said("urgency_level", "none"), said("language", "unknown")


def system_prompt(persona: str = "expert", reasoning: str = "direct") -> str:
    """Our own wording of the task for a model: persona `expert` or `basic`, reasoning `cot` or `direct`."""
    who = "You are a security analyst who knows the tricks of mobile fraud. " if persona == "expert" else ""
    task = "Classify the message as ham (wanted), spam (unwanted advertising) or smishing (fraud by text message)."
    keys = 'two keys, "reasoning" (a short deduction) and "label"' if reasoning == "cot" else 'one key, "label"'
    return f'{who}{task}\n\nAnswer with a JSON object of {keys}; the label is one of "ham", "spam", "smishing". Write nothing else.'
