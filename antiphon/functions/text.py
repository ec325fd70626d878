"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from antiphon.functions.let import let

# Fixed value: an answer's opening that refuses. Anchored at the start; an apology alone is no refusal.
REFUSAL_OPENING = (
    r"\A\s*(?:as\s+an?\s+(?:ai(?:\s+(?:language\s+)?model|\s+assistant)?|language\s+model|assistant)\s*[,;:]\s*)?"
    r"(?:(?:i\s*(?:am|'m|’m)\s+sorry|sorry|apologies)\s*[,!.:;—–-]*\s*(?:but\s+)?)*"
    r"(?:i\s+(?:cannot|can\s*not|can't|can’t|won't|won’t|will\s+not)\b"
    r"|i\s*(?:am|'m|’m)\s+(?:unable|not\s+able)\s+to\b"
    r"|i\s+(?:(?:must|have\s+to|need\s+to)\s+)?(?:decline|refuse)\b"
    r"|i\s+(?:do\s+not|don't|don’t)\s+(?:provide|assist|help|support)\b"
    r"|(?:i\s*'m|i’m|i\s+am)\s+not\s+(?:permitted|allowed)\s+to\b"
    r"|(?:this|that|your)\s+(?:request|question)\s+(?:is|would\s+be)\s+(?:something\s+)?i\s+(?:cannot|can't|can’t)\b"
    r"|(?:i\s*'m|i’m|i\s+am)\s+afraid\s+i\s+(?:cannot|can't|can’t|won't|won’t)\b)"
)
# Fixed value: a narrower one, which refuses a task ("I cannot stop thinking about it" is none).
TASK_REFUSAL = (
    r"\A\s*(?:(?:I'm sorry|I am sorry|Sorry|As an AI[^,.]*|As a language model)[,.!:\s]*)*"
    r"I\s+(?:cannot|can't|won't|will not|am unable to|must decline to)\s+"
    r"(?:help|assist|provide|comply|fulfil|fulfill|write|generate|discuss)\b"
)
# Fixed value: names of the classes, which a text must not give away.
CLASS_NAMES = r"\b(?:depression|curiosity|paranoia|sexual arousal|narcissism|euphoria)\b"
# Fixed value: texts that look like credentials.
SECRET_TEXT = r"hf_[A-Za-z0-9]{24,}|sk-or-v1-[A-Za-z0-9_-]{16,}|-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"
SCORE = r"\A(?:100|[1-9]?[0-9])\z"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (trim() knows only blanks)."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def casefold(text: Column) -> Column:
    """Letters without case, ß as ss: capitals first, which write such letters out, then small ones, with one small sigma. (The optimizer would drop the capitals if nothing stood between.)"""
    return F.replace(F.lower(F.replace(F.upper(text), F.lit("ẞ"), F.lit("SS"))), F.lit("ς"), F.lit("σ"))


def padded(number: Column, digits: int) -> Column:
    """With zeros in front up to so many digits; longer numbers stay whole (lpad would cut them)."""
    text = number.cast("string")
    return F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0"))


def text_key(text: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends. casefold_key() is the exact form for letters like ß."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def casefold_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(casefold(text), r"(?U)\s+", " "))


def word_list(text: Column) -> Column:
    """Runs of letters, digits and underscores, without case."""
    return F.regexp_extract_all(casefold(text), F.lit(r"(?U)\w+"), 0)


def plain_words(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), 0)


def blank_separated(text: Column) -> Column:
    return F.when(strip(text) == "", F.array().cast("array<string>")).otherwise(F.split(strip(text), r"(?U)\s+"))


def grams(words: Column, n: int) -> Column:
    """64-bit hashes of n neighbours; empty where there are fewer words. Arrays of numbers, one beside the other: no string is made for a gram."""

    def of(h: Column) -> Column:
        out, count = h, F.greatest(F.size(h) - (n - 1), F.lit(0))
        for k in range(1, n):
            out = F.zip_with(out, F.slice(h, F.lit(k + 1), F.greatest(F.size(h) - k, F.lit(0))), lambda a, b: F.xxhash64(a, b))
        return F.slice(out, F.lit(1), count)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def trigram_repetition(words: Column) -> Column:
    """1 - distinct / all trigrams; 0 where there are none."""
    return let(grams(words, 3), lambda g: F.when(F.size(g) > 0, 1 - F.size(F.array_distinct(g)) / F.size(g)).otherwise(F.lit(0.0)))


def longest_character_run(text: Column, least: int = 32) -> Column:
    runs = F.transform(F.regexp_extract_all(text, F.lit(rf"(\S)\1{{{least - 1},}}"), 0), F.length)
    return F.coalesce(F.array_max(runs), F.lit(0))


def opening(text: Column) -> Column:
    """Where a refusal would begin: without emphasis marks around it."""
    bare = F.replace(F.replace(strip(text), F.lit("**"), F.lit("")), F.lit("__"), F.lit(""))
    return F.regexp_replace(bare, r"\A[*_]", "")


def refusal_match(text: Column) -> Column:
    """What of the opening refuses, or an empty string."""
    return strip(F.regexp_extract(opening(F.coalesce(text, F.lit(""))), f"(?iU){REFUSAL_OPENING}", 0))


def task_refusal(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"(?iU){TASK_REFUSAL}")


def degenerate(text: Column) -> Column:
    """Empty; or 24 words or more that repeat by 0.65; or a run of 32 equal characters or more that is 0.65 of the text."""

    def rule(bare: Column, words: Column, run: Column) -> Column:
        share = F.when(F.length(bare) > 0, run / F.length(bare)).otherwise(F.lit(0.0))
        return (bare == "") | ((F.size(words) >= 24) & (F.greatest(trigram_repetition(words), share) >= 0.65)) | ((run >= 32) & (share >= 0.65))

    return let(strip(F.coalesce(text, F.lit(""))), lambda bare: let(F.struct(word_list(bare).alias("w"), longest_character_run(bare).alias("r")), lambda x: rule(bare, x["w"], x["r"])))


def parse_score(text: Column) -> Column:
    """0 to 100, or null (never 0) for anything but such a number."""
    bare = strip(text)
    return F.when(bare.rlike(SCORE), bare.cast("int"))


def render(template: Column, values: dict[str, Column]) -> Column:
    """Placeholders {name} by values in one pass: what comes in is not looked at again."""
    parts = F.regexp_extract_all(template, F.lit(r"(?s)\{(?:" + "|".join(values) + r")\}|\{|[^{]+"), 0)

    def fill(part: Column) -> Column:
        out = part
        for name, value in values.items():
            out = F.when(part == f"{{{name}}}", value).otherwise(out)
        return out

    return F.array_join(F.transform(parts, fill), "")


def html_escape(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def stable_seed(text: Column) -> Column:
    """The first 32 bits of SHA-256, as a long."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


# Fixed value: a code fence around a whole answer.
FENCE = r"```(?:[A-Za-z0-9_+.-]+)?\s*\n(.*?)\n?```"
#: What may stand around an answer: patterns whose one group is the answer.
WRAPPERS = (FENCE, "`([^`]*)`", r"\*\*((?:(?!\*\*).)*)\*\*")


def unwrapped_answer(text: Column) -> Column:
    """Without one of WRAPPERS around the whole."""

    def bare(x: Column) -> Column:
        inner = (F.regexp_extract(x, rf"(?s)\A{w}\z", 1) for w in WRAPPERS)
        return F.coalesce(*(F.when(x.rlike(rf"(?s)\A{w}\z"), strip(i)) for w, i in zip(WRAPPERS, inner)), x)

    return let(strip(text), bare)


def answer_matches(text: Column, pattern: Column) -> Column:
    """Whether a final answer has what the pattern expects; empty answers never do."""
    return F.coalesce(strip(text) != "", F.lit(False)) & F.rlike(unwrapped_answer(text), F.concat(F.lit("(?i)"), pattern))


def safe_path(path: Column) -> Column:
    """Relative, with no empty, "." or ".." part and no backslash."""
    return ~path.rlike(r"\A/|\\|\x00") & F.forall(F.split(path, "/"), lambda p: ~p.isin("", ".", ".."))


def after_reasoning(text: Column) -> Column:
    """What follows the last end of reasoning, or the whole."""
    return strip(F.element_at(F.split(text, "</think>"), -1))


def apostrophe_words(text: Column) -> Column:
    """Runs of letters and digits, also joined by single apostrophes of either kind, without case."""
    return F.regexp_extract_all(F.replace(casefold(text), F.lit("’"), F.lit("'")), F.lit(r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*"), 0)


def redacted(message: Column, secret: str, most: int = 2000) -> Column:
    """A message's beginning without the secret."""
    return F.replace(F.left(message, F.lit(most)), F.lit(secret), F.lit("[redacted]"))


def axis_title(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def date_label(time: Column, today: Column) -> Column:
    """today, yesterday, or day and month."""
    days = F.datediff(today, time.cast("date"))
    return F.when(days == 0, "today").when(days == 1, "yesterday").otherwise(F.lower(F.date_format(time, "d MMM")))


# Fixed value: keys that must not be published, at any depth.
PRIVATE_KEYS = (
    "response", "responses", "raw_response", "raw_responses", "messages", "question",
    "prompt", "input_ids", "raw_judge_output", "raw_judge_outputs", "raw", "api_key",
    "hf_token", "openrouter_api_key", "authorization",
)


def _decoded(string: Column) -> Column:
    """What a JSON string stands for, escapes and all."""
    return F.from_json(F.concat(F.lit("["), string, F.lit("]")), "array<string>")[0]


def _strings(document: Column, keys: bool) -> Column:
    """The strings of a JSON text that are keys, or those that aren't.

    Escaped backslashes and quotation marks are put aside first (as control characters, which no string may hold), so that what is
    left of quotation marks are ends of strings, and a string of any length is one simple run.
    """
    bare = F.replace(F.replace(document, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    all_of = F.regexp_extract_all(bare, F.lit(r'"[^"]*+"(?:\s*:)?'), 0)
    own = F.filter(all_of, lambda s: F.endswith(s, F.lit(":")) if keys else ~F.endswith(s, F.lit(":")))
    whole = lambda s: F.replace(F.replace(F.regexp_extract(s, r'\A"[^"]*+"', 0), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    return F.transform(own, lambda s: _decoded(whole(s)))


def private_keys(document: Column) -> Column:
    """Those of PRIVATE_KEYS that an object of a JSON text has, at any depth and however they are written, sorted. Strings are read whole, so what stands inside of one is no key."""
    keys = F.transform(_strings(document, True), F.lower)
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: k.isin(*PRIVATE_KEYS))))


def holds_credential(document: Column) -> Column:
    """Whether a string of a JSON text, but for keys, has what looks like a credential."""
    return F.exists(_strings(document, False), lambda s: F.coalesce(F.rlike(s, F.lit(SECRET_TEXT)), F.lit(False)))


def publication_faults(document: Column) -> Column:
    """Why a JSON text must not be published, in order: "malformed" alone if it's no JSON object (one with a key twice is none), else "credential" and "key <name>" for each private key."""
    whole = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(document)), F.lit("OBJECT")), F.lit(False))
    found = F.concat(F.when(holds_credential(document), F.array(F.lit("credential"))).otherwise(F.array().cast("array<string>")), F.transform(private_keys(document), lambda k: F.concat(F.lit("key "), k)))
    return F.when(whole, found).otherwise(F.array(F.lit("malformed")))
