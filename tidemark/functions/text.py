"""Column functions on text: sentences, names, price commentary, hashes, mentions and name substitution."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import fixed

CLEAN_BREAK = r"(?<=[.!?])\s+(?=[A-Z(\"])"


def fix_missing_space(text: Column) -> Column:
    """A blank after a stop that runs into a capital letter."""
    return F.regexp_replace(text, r"(?<=[a-z0-9])([.!?])(?=[A-Z])", "$1 ")


def sentences(text: Column, least: int = fixed.LEAST_SENTENCE_CHARS) -> Column:
    """Sentences of at least `least` characters, trimmed of white space."""
    pieces = F.transform(F.split(text, CLEAN_BREAK), strip)
    return F.filter(pieces, lambda s: F.length(s) >= least)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def name_pattern(aliases: list[str]) -> str | None:
    """Java pattern for any alias, longest first, not inside a word or a hyphenated one."""
    if not aliases:
        return None
    quoted = sorted((re.sub(r"([^A-Za-z0-9 ])", r"\\\1", a) for a in aliases), key=len, reverse=True)
    return r"(?i)(?<![A-Za-z0-9-])(?:" + "|".join(quoted) + r")(?![A-Za-z0-9-])"


def names_any(text: Column, aliases: list[str]) -> Column:
    pattern = name_pattern(aliases)
    return F.lit(False) if pattern is None else F.coalesce(text, F.lit("")).rlike(pattern)


def aliases(key: str, tier: str) -> list[str]:
    return fixed.COMPANIES[key].get(tier, [])


def company_name(key: str) -> str:
    names = fixed.COMPANIES.get(key, {}).get("names", [])
    return names[0] if names else key


def company_registry(spark: SparkSession) -> DataFrame:
    """(key, names, person, products), one row for each company."""
    rows = [(k, v.get("names", []), v.get("person", []), v.get("products", [])) for k, v in fixed.COMPANIES.items()]
    return spark.createDataFrame(rows, "key string, names array<string>, person array<string>, products array<string>")


_WORDS = dict(zip(fixed.STRONG_PATTERNS + fixed.WEAK_PATTERNS, fixed.STRONG_WORDS + fixed.WEAK_WORDS, strict=True))
#: Letters that patterns take for an ASCII one and lower() does not make one: long s, Kelvin sign, I with and without a dot.
_ODD = "\u017f\u212a\u0130\u0131"


def _lowered(text: Column, made: Callable[[Column, Column], Column]) -> Column:
    """made(text, text in lower case), both computed once; a text with odd letters has all words in place of its own."""
    every = " ".join(sorted({w for words in _WORDS.values() for group in words for w in group}))
    low = F.when(text.rlike(f"[{_ODD}]"), F.lit(every)).otherwise(F.lower(text))
    return F.transform(F.array(F.struct(text.alias("text"), low.alias("low"))), lambda r: made(r["text"], r["low"]))[0]


def _fires(text: Column, low: Column, pattern: str) -> Column:
    """Whether a price-commentary pattern fires; it is only sought in a text that holds its words."""
    held = [reduce(lambda a, b: a | b, [low.contains(w) for w in group]) for group in _WORDS[pattern]]
    return reduce(lambda a, b: a & b, held) & text.rlike(f"(?iU){pattern}")


def _hits(text: Column, patterns: list[str]) -> Column:
    got = _lowered(text, lambda t, low: F.array(*[F.when(_fires(t, low, p), F.regexp_extract(t, f"(?iU){p}", 0)) for p in patterns]))
    return F.filter(got, lambda x: x.isNotNull())


def reactive_score(text: Column, strong: float = 1.0, weak: float = 0.5) -> Column:
    """Weighted number of price-commentary patterns that fire, each counted once."""
    fired = lambda t, low, patterns: reduce(lambda a, b: a + b, [_fires(t, low, p).cast("int") for p in patterns])
    return _lowered(F.coalesce(text, F.lit("")), lambda t, low: strong * fired(t, low, fixed.STRONG_PATTERNS) + weak * fired(t, low, fixed.WEAK_PATTERNS))


def reactive_hits(text: Column, prefix: str = "") -> Column:
    """First match of each pattern that fires, marked ! for strong and ? for weak."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(
        F.transform(_hits(text, fixed.STRONG_PATTERNS), lambda m: F.concat(F.lit(f"{prefix}! "), m)),
        F.transform(_hits(text, fixed.WEAK_PATTERNS), lambda m: F.concat(F.lit(f"{prefix}? "), m)),
    )


def reactive_article_score(headline: Column, summary: Column, body: Column) -> Column:
    return reactive_score(headline) + reactive_score(summary, 0.5, 0.25) + reactive_score(body, 0.2, 0.1)


def text_hash(text: Column) -> Column:
    return F.substring(F.sha2(strip(text), 256), 1, 16)


def pair_hash(text: Column, aspect: Column) -> Column:
    return text_hash(F.concat(strip(text), F.lit("\x00"), strip(aspect)))


def sample_id(stratum: Column, article_id: Column, sent_idx: Column) -> Column:
    return F.concat_ws("-", stratum, article_id.cast("string"), sent_idx.cast("string"))


def is_person(surface: Column) -> Column:
    """A title or another word for a person in the mention."""
    return F.coalesce(surface, F.lit("")).rlike("(?i)" + fixed.TITLE_WORDS)


def product_keys() -> list[str]:
    return [p.strip().casefold() for c in fixed.COMPANIES.values() for p in c.get("products", []) if p.strip()]


def _bare(token: Column) -> Column:
    return F.regexp_replace(token, "(?i)(?:'s|’s)$", "")


def is_substitutable(surface: Column) -> Column:
    """Whether a company's name may stand in place of the mention."""
    low = F.lower(strip(F.coalesce(surface, F.lit(""))))
    tokens = F.filter(F.split(low, r"(?U)\s+"), lambda t: t != "")
    n = F.size(tokens)
    last = F.regexp_replace(_bare(F.try_element_at(tokens, F.lit(-1))), "^[.,;:!?()\\[\\]\"'“”‘’]+|[.,;:!?()\\[\\]\"'“”‘’]+$", "")
    headed = last.isin(fixed.COMPANY_HEAD_NOUNS)
    determined = (n <= 1) | _bare(F.try_element_at(tokens, F.lit(1))).isin(fixed.MENTION_DETERMINERS)
    phrase = (n > 0) & (n <= fixed.MOST_MENTION_TOKENS) & headed & determined & ~strip(_bare(low)).isin(product_keys())
    return F.coalesce(low.isin(fixed.MENTION_PRONOUNS) | phrase, F.lit(False))


def inflected(name: Column, surface: Column) -> Column:
    """`name` in the form the mention had: are, is, possessive or bare, with its capital."""
    s = strip(F.coalesce(surface, F.lit("")))
    low = F.lower(s)
    owned = F.when(F.lower(name).rlike("(?:'s|’s)$"), name).otherwise(F.concat(name, F.lit("'s")))
    out = (
        F.when(low.isin(fixed.CONTRACTIONS_ARE), F.concat(name, F.lit(" are")))
        .when(low.isin(fixed.CONTRACTIONS_IS), F.concat(name, F.lit(" is")))
        .when(low.isin(fixed.POSSESSIVE_PRONOUNS) | low.rlike("(?:'s|’s)$"), owned)
        .otherwise(name)
    )
    first = F.substring(out, 1, 1)
    raised = F.substring(s, 1, 1).rlike(r"^\p{Lu}$") & first.rlike(r"^\p{Ll}$")
    return F.when(raised, F.concat(F.upper(first), F.substr(out, F.lit(2)))).otherwise(out)


def clitic(surface: Column, tail: Column) -> tuple[Column, Column]:
    """(word it stands for, its length) of an apostrophe form right after a bare pronoun; NULL and 0 without one."""
    bare = F.lower(strip(F.coalesce(surface, F.lit("")))).isin(fixed.BARE_PRONOUNS)
    word, size = F.lit(None).cast("string"), F.lit(0)
    for form, expansion in reversed(fixed.CLITICS):
        here = bare & F.lower(tail).startswith(form)
        word, size = F.when(here, F.lit(expansion)).otherwise(word), F.when(here, F.lit(len(form))).otherwise(size)
    return word, size


def substitution(text: Column, start: Column, end: Column, name: Column) -> tuple[Column, Column]:
    """(text with the mention replaced, outcome); the text stays as it is unless the outcome is `substituted`."""
    spanless = start.isNull() | end.isNull()
    surface = F.substr(text, F.greatest(start, F.lit(0)) + 1, F.greatest(end - start, F.lit(0)))
    bad = (start < 0) | (end > F.length(text)) | (end <= start)
    outcome = (
        F.when(spanless, "no_span")
        .when(is_person(surface), "person")
        .when(~is_substitutable(surface), "not_mention")
        .when(bad, "bad_span")
        .otherwise("substituted")
    )
    word, size = clitic(surface, F.substr(text, end + 1))
    put = F.concat(inflected(name, surface), F.coalesce(F.concat(F.lit(" "), word), F.lit("")))
    new = F.concat(F.substr(text, F.lit(1), start), put, F.substr(text, end + size + 1))
    return F.when(outcome == "substituted", new).otherwise(text), outcome


def marked(sentence: Column, start: Column, end: Column, marker: str = "**") -> Column:
    """The sentence with the mention between markers; as it is without a span."""
    m = F.lit(marker)
    put = F.concat(F.substr(sentence, F.lit(1), start), m, F.substr(sentence, start + 1, end - start), m, F.substr(sentence, end + 1))
    return F.when(start.isNotNull() & end.isNotNull(), put).otherwise(sentence)


def rendered(headline: Column, preceding: Column, sentence: Column, following: Column) -> Column:
    """Headline, a blank line, the sentences around with the middle one pointed at."""
    indent = lambda a: F.transform(a, lambda s: F.concat(F.lit("  "), s))
    lines = F.concat(F.array(F.concat(F.lit("HEADLINE: "), headline), F.lit("")), indent(preceding), F.array(F.concat(F.lit("> "), sentence)), indent(following))
    return F.array_join(lines, "\n")
