"""Column functions for scores, populations and small statistics. NULL means missing throughout."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.fixed import CONF_FLOOR, SHRINKAGE_K

VARIANTS = ["fin", "absa", "mean_blend", "sign_graft", "conf_graft", "conf_graft_soft", "conf_graft_floor", "gated", "agree_only"]


def flag(name: str, df: DataFrame | None = None) -> Column:
    """A boolean column with NULL as false; false everywhere when `df` is given and lacks it."""
    if df is not None and name not in df.columns:
        return F.lit(False)
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False))


def missing(x: Column) -> Column:
    """NaN as NULL."""
    return F.when(~F.isnan(x), x)


def needs_score(df: DataFrame) -> Column:
    """Sentences worth scoring: about the target or its chief, and not boilerplate."""
    absent = [c for c in ("mentions_target", "mentions_ceo") if c not in df.columns]
    if absent:
        raise ValueError(f"sentence table lacks {absent}")
    return (flag("mentions_target") | flag("mentions_ceo")) & ~flag("is_boilerplate", df)


def target_population(df: DataFrame) -> Column:
    return flag("mentions_target") & ~flag("is_boilerplate", df)


def chief_only(df: DataFrame) -> Column:
    return flag("mentions_ceo") & ~flag("mentions_target") & ~flag("is_boilerplate", df)


def chief_any(df: DataFrame) -> Column:
    return flag("mentions_ceo") & ~flag("is_boilerplate", df)


def judge_population(df: DataFrame) -> Column:
    return target_population(df) & flag("resolved_by_coref", df)


def accept_only(answer: Column) -> Column:
    """True for a yes in any case and spacing, false for all else."""
    return F.coalesce(F.lower(F.trim(answer.cast("string"))) == "yes", F.lit(False))


def provenance_channel(df: DataFrame) -> Column:
    """surface, coref_span or coref_nospan; NULL outside the target population."""
    by_coref = flag("resolved_by_coref", df)
    spanned = F.col("mention_char_start").isNotNull() if "mention_char_start" in df.columns else F.lit(False)
    return F.when(flag("mentions_target"), F.when(~by_coref, "surface").when(spanned, "coref_span").otherwise("coref_nospan"))


def signed(pos: str, neg: str) -> Column:
    return F.col(pos) - F.col(neg)


def score_variants(deadband: float = 0.0) -> dict[str, Column]:
    """The fusion candidates over pos, neg, absa_pos, absa_neg, absa_neu; NULL where a scorer is missing."""
    fin, absa = signed("pos", "neg"), signed("absa_pos", "absa_neg")
    size = F.abs(fin)
    both = fin.isNotNull() & absa.isNotNull()
    grafted = F.when(both & (F.abs(absa) < deadband), F.lit(0.0)).otherwise(F.signum(absa) * size)
    out = {
        "fin": fin,
        "absa": absa,
        "mean_blend": (fin + absa) / 2,
        "sign_graft": grafted,
        "conf_graft": absa * size,
        "conf_graft_soft": F.signum(absa) * size * (F.lit(0.5) + 0.5 * F.abs(absa)),
        "conf_graft_floor": fused(fin, absa),
        "gated": fin * (1 - F.col("absa_neu")),
        "agree_only": F.when(both, F.when(F.signum(fin) == F.signum(absa), fin).otherwise(F.lit(0.0))),
    }
    return out


def fused(fin: Column, absa: Column, floor: float = CONF_FLOOR) -> Column:
    """The shipped score: the sign of `absa`, the size of `fin`, scaled from `floor` to 1 by the size of `absa`.

    The rest above the floor is taken in decimals (0.3 of 0.7, not 0.30000000000000004): scores of equal size stay equal,
    and the first of them is the loudest.
    """
    return F.signum(absa) * F.abs(fin) * (F.lit(floor) + float(1 - Decimal(str(floor))) * F.abs(absa))


def fuse(pos: str = "pos", neg: str = "neg", absa_pos: str = "absa_pos", absa_neg: str = "absa_neg", floor: float = CONF_FLOOR) -> Column:
    return fused(signed(pos, neg), signed(absa_pos, absa_neg), floor)


def shrink(raw: Column, n: Column, k: float = SHRINKAGE_K) -> Column:
    return raw * (n.cast("double") / (n + F.lit(k)))


def direction(ret: Column) -> Column:
    return F.coalesce(F.signum(ret), F.lit(0.0)).cast("int")


def isclose(a: Column, b: Column, atol: float = 1e-9, rtol: float = 1e-5) -> Column:
    return F.coalesce(F.abs(a - b) <= atol + rtol * F.abs(b), F.lit(False))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of k in n; NULL when n is 0."""
    k, n = k.cast("double"), n.cast("double")
    share = F.when(n > 0, k / n)
    scale = F.when(n > 0, 1 + z * z / n)
    centre = (share + z * z / (2 * n)) / scale
    half = z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n)) / scale
    return centre - half, centre + half


def from_unix(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def top_mean(x: Column, n: int = 3, largest: bool = True) -> Column:
    """Mean of the n largest or smallest values, of what there is if fewer, NULL if none.

    Aggregate. The group's values are sorted in one row, so it is meant for groups the size of a document.
    """
    some = F.slice(F.sort_array(F.collect_list(x), asc=not largest), 1, n)
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda a, b: a + b) / F.size(some))


def loudest(x: Column, order: Column) -> Column:
    """Aggregate: the value furthest from zero with its sign, the first by `order` among equals, NULL if none.

    A NULL of `order` comes before all others, as it does in the queries' SQL; Spark alone would put it behind them.
    """
    return F.max_by(x, F.when(x.isNotNull(), F.struct(F.abs(x), order.isNull(), -order)))
