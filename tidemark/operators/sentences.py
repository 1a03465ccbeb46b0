"""From article bodies to tagged sentences, scoring pairs, and what a judge reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions import fixed
from tidemark.functions import scores as S
from tidemark.functions import text as T

SENTENCE_COLUMNS = ["article_id", "sent_idx", "text", "mentions_target", "mentions_ceo", "resolved_by_coref", "is_boilerplate", "char_len", "mention_char_start", "mention_char_end"]


def explode_sentences(docs: DataFrame, body: str = "text", least: int = fixed.LEAST_SENTENCE_CHARS) -> DataFrame:
    """(article_id, sent_idx, text): sent_idx counts the sentences that are long enough."""
    return docs.select("article_id", F.posexplode(T.sentences(F.col(body), least)).alias("sent_idx", "text"))


def located_sentences(docs: DataFrame, body: str = "text", least: int = fixed.LEAST_SENTENCE_CHARS) -> DataFrame:
    """explode_sentences() with offset: where each sentence starts in the body."""
    step = f"""aggregate(_s, named_struct('at', 1, 'out', cast(array() as array<struct<offset: int, text: string>>)),
        (acc, s) -> named_struct('at', locate(s, `{body}`, acc.at) + length(s), 'out', concat(acc.out, array(named_struct('offset', locate(s, `{body}`, acc.at) - 1, 'text', s)))), acc -> acc.out)"""
    return docs.withColumn("_s", T.sentences(F.col(body), least)).select("article_id", F.posexplode(F.expr(step)).alias("sent_idx", "_r")).select("article_id", "sent_idx", F.col("_r.offset").alias("offset"), F.col("_r.text").alias("text"))


def tag_sentences(sentences: DataFrame, ticker: str, mentions: DataFrame | None = None) -> DataFrame:
    """SENTENCE_COLUMNS for one company's sentences (article_id, sent_idx, text, and offset with mentions).

    A name in the sentence makes it the target's. Otherwise a resolved mention that lies wholly inside
    does, and the earliest one a name can stand for, no person's, is its span. `mentions` is (article_id, start,
    end) in body offsets, and `person` where a parse has told persons.
    """
    named, chief = T.names_any(F.col("text"), T.aliases(ticker, "names")), T.names_any(F.col("text"), T.aliases(ticker, "person"))
    out = sentences.withColumn("_named", named).withColumn("mentions_ceo", chief)
    if mentions is None:
        out = out.withColumn("_hit", F.lit(False)).withColumn("_span", F.lit(None).cast("struct<s: int, e: int>"))
    else:
        person = F.coalesce("person", F.lit(False)) if "person" in mentions.columns else F.lit(False)
        m = mentions.select("article_id", F.col("start").alias("_a"), F.col("end").alias("_b"), person.alias("_person")).where("_b > _a")
        inside = (F.col("_a") >= F.col("offset")) & (F.col("_b") <= F.col("offset") + F.length("text"))
        met = out.where(~F.col("_named")).select("article_id", "sent_idx", "text", "offset").join(m, "article_id").where(inside)
        surface = F.expr("substr(text, cast(_a - offset + 1 as int), cast(_b - _a as int))")
        usable = ~F.col("_person") & ~T.is_person(surface) & T.is_substitutable(surface)
        span = F.struct((F.col("_a") - F.col("offset")).cast("int").alias("s"), (F.col("_b") - F.col("offset")).cast("int").alias("e"))
        spans = met.groupBy("article_id", "sent_idx").agg(F.lit(True).alias("_hit"), F.min(F.when(usable, span)).alias("_span"))
        out = out.join(spans, ["article_id", "sent_idx"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    out = out.withColumn("mentions_target", F.col("_named") | F.col("_hit")).withColumn("resolved_by_coref", ~F.col("_named") & F.col("_hit"))
    out = out.withColumn("is_boilerplate", F.lit(False)).withColumn("char_len", F.length("text"))
    out = out.withColumn("mention_char_start", F.col("_span.s")).withColumn("mention_char_end", F.col("_span.e"))
    return out.select(*SENTENCE_COLUMNS)


def map_clusters(docs: DataFrame, ticker: str, body: str = "text", clusters: str = "clusters", persons: str | None = None, expletives: str | None = None) -> DataFrame:
    """(article_id, start, end, person): the mentions of every cluster that names the company in some mention but a person's.

    `persons` and `expletives` are columns of spans that a parse has found; without one there are none. A mention that
    overlaps a person, or holds a title, cannot name the company nor be replaced by its name; one that overlaps an
    expletive, an "it" that refers to nothing, is no mention.
    """
    pattern = T.name_pattern(T.aliases(ticker, "names"))
    met = lambda spans: "false" if spans is None else f"exists(coalesce(`{spans}`, array()), p -> m.s < p.e and p.s < m.e)"
    over = met(persons)
    quoted = lambda p: p.replace("\\", "\\\\").replace("'", "\\'")
    surface = f"substr(`{body}`, m.s + 1, m.e - m.s)"
    names = "false" if pattern is None else f"{surface} rlike '{quoted(pattern)}'"
    keyed = F.expr(f"filter(`{clusters}`, c -> exists(c, m -> m.e > m.s and not ({over}) and not {surface} rlike '(?i){quoted(fixed.TITLE_WORDS)}' and {names}))")
    flat = docs.withColumn("_m", F.flatten(keyed)).withColumn("_m", F.expr(f"filter(_m, m -> not {met(expletives)})"))
    flat = flat.withColumn("_m", F.expr(f"transform(_m, m -> named_struct('start', m.s, 'end', m.e, 'person', {over}))"))
    return flat.select("article_id", F.explode("_m").alias("m")).select("article_id", "m.start", "m.end", "m.person")


def tag_reactive(sentences: DataFrame, threshold: float = 1.0) -> DataFrame:
    score = T.reactive_score(F.col("text"))
    return sentences.withColumn("reactive_score", score).withColumn("is_reactive", (F.col("reactive_score") >= threshold).cast("int")).withColumn("reactive_hits", T.reactive_hits(F.col("text")))


def build_pairs(sentences: DataFrame, ticker: str) -> DataFrame:
    """Adds absa_text and absa_aspect, '' where a sentence has no pair.

    The company's name is the aspect of its sentences, put in place of a resolved mention where that is
    allowed; the chief's name as written is the aspect of sentences about the chief alone.
    """
    names = T.aliases(ticker, "names")
    name = F.lit(names[0] if names else None).cast("string")
    text = F.coalesce(F.col("text"), F.lit(""))
    put, _ = T.substitution(text, F.col("mention_char_start"), F.col("mention_char_end"), name)
    pattern = T.name_pattern(T.aliases(ticker, "person"))
    chief = F.regexp_extract(text, pattern, 0) if pattern else F.lit("")
    score, target = S.needs_score(sentences), S.flag("mentions_target")
    about = score & target & name.isNotNull()
    alone = score & ~target & S.flag("mentions_ceo") & (chief != "")
    absa_text = F.when(about, F.when(S.flag("resolved_by_coref", sentences), put).otherwise(text)).when(alone, text).otherwise("")
    return sentences.withColumn("absa_text", absa_text).withColumn("absa_aspect", F.when(about, name).when(alone, chief).otherwise(""))


def contexts(sentences: DataFrame, headlines: DataFrame, before: int = fixed.CONTEXT_PRECEDING, after: int = fixed.CONTEXT_FOLLOWING) -> DataFrame:
    """`sentences` with headline, preceding and following texts by sent_idx distance, and the rendered context."""
    w = W.partitionBy("article_id").orderBy("sent_idx")
    out = sentences.withColumn("preceding", F.collect_list("text").over(w.rangeBetween(-before, -1))).withColumn("following", F.collect_list("text").over(w.rangeBetween(1, after)))
    out = out.join(headlines.select("article_id", "headline"), "article_id", "left").withColumn("headline", F.coalesce("headline", F.lit("")))
    shown = T.marked(F.col("text"), F.col("mention_char_start"), F.col("mention_char_end")) if "mention_char_start" in sentences.columns else F.col("text")
    return out.withColumn("context", T.rendered(F.col("headline"), F.col("preceding"), shown, F.col("following")))


def prompts(built: DataFrame, ticker: str, system: str, instruction: str, instruction_no_span: str) -> DataFrame:
    """Adds prompt: chat text of the system line, the instruction for spanned or spanless rows, and the context.

    `{company}` in an instruction is the company's display name.
    """
    company = T.company_name(ticker)
    spanned = F.col("mention_char_start").isNotNull() & F.col("mention_char_end").isNotNull()
    ask = F.when(spanned, F.lit(instruction.replace("{company}", company))).otherwise(F.lit(instruction_no_span.replace("{company}", company)))
    text = F.concat(F.lit(f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n"), ask, F.lit("\n\n---\n"), F.col("context"), F.lit("\n---<|im_end|>\n<|im_start|>assistant\n"))
    return built.withColumn("prompt", text)


def stratum(df: DataFrame, rules: list[tuple[str, object]], otherwise: str | None = None) -> DataFrame:
    """Adds stratum: the name of the first rule (name, condition) that holds."""
    out = None
    for name, condition in rules:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return df.withColumn("stratum", out if otherwise is None else out.otherwise(otherwise))


def seeded(*columns: str, seed: int = 0):
    """A reproducible random order over the values of columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def sample_rows(df: DataFrame, keys: list[str], n: int, seed: int = 0) -> DataFrame:
    return df.orderBy(seeded(*keys, seed=seed), *keys).limit(n)


def stratified_sample(df: DataFrame, keys: list[str], by: str = "stratum", unit: str = "article_id", per_stratum: int = 50, per_unit: int = 2, seed: int = 0) -> DataFrame:
    """At most `per_unit` rows of a unit and `per_stratum` of a stratum, in a seeded order."""
    order = seeded(*keys, seed=seed)
    first = df.withColumn("_o", order).withColumn("_n", F.row_number().over(W.partitionBy(by, unit).orderBy("_o", *keys))).where(F.col("_n") <= per_unit)
    return first.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy("_o", *keys))).where(F.col("_n") <= per_stratum).drop("_n", "_o")
