"""Risk rules as column expressions: bands, scores, factors and validation."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave import fixed_values as V
from riskweave.functions.scalars import rounded


def area_of(region: Column) -> Column:
    """Roll a region up to its area; a region of no area stands for itself."""
    pairs = [(region.isin(*names), F.lit(area)) for area, names in V.AREAS.items()]
    return _cases(pairs, region)


def _cases(pairs, otherwise) -> Column:
    first, *rest = pairs
    chain = reduce(lambda c, p: c.when(*p), rest, F.when(*first))
    return chain if otherwise is None else chain.otherwise(otherwise)


def _band(x: Column, bounds) -> Column:
    return _cases([(x >= low, F.lit(name)) for low, name in bounds], F.lit(V.LOWEST_BAND))


def provider_tier(flagged_pct: Column) -> Column:
    return _band(flagged_pct, V.PROVIDER_TIERS)


def risk_category(score: Column) -> Column:
    return _band(score, V.SCORE_CATEGORIES)


def severity_rank(severity: Column) -> Column:
    """1 for critical to 4 for low; null for anything else."""
    return _cases([(severity == s, F.lit(r)) for s, r in V.SEVERITY_RANKS.items()], None)


def flag_probability(region: Column, provider_type: Column, amount: Column) -> Column:
    """Chance that a claim is flagged. A risky type raises the regional rate, and a
    large amount adds to whatever came before."""
    regional = F.when(region.isin(*V.MACAU_DISTRICTS), 0.30).otherwise(0.08)
    typed = F.when(provider_type.isin(*V.RISKY_PROVIDER_TYPES), F.greatest(regional, F.lit(0.25)))\
        .otherwise(regional)
    return typed + F.when(amount > 200_000, 0.10).otherwise(0.0)


def breach_probability(incident_type: Column) -> Column:
    pairs = [(incident_type == t, F.lit(p)) for t, p in V.BREACH_PROBABILITY.items()]
    return _cases(pairs, F.lit(V.BREACH_PROBABILITY_ELSE))


def report_required(breach: Column, severity: Column, draw: Column) -> Column:
    """Every breach is reported; a critical incident is with probability 0.8."""
    return breach | ((severity == "critical") & (draw < 0.8))


def estimated_loss(flagged: Column, amount: Column, share: Column) -> Column:
    return F.when(flagged, rounded(amount * share, 2)).otherwise(0.0)


@dataclass(frozen=True)
class ClaimColumns:
    """The columns a claim is scored from."""

    claim_type: Column = field(default_factory=lambda: F.col("claim_type"))
    amount: Column = field(default_factory=lambda: F.col("claim_amount_hkd"))
    channel: Column = field(default_factory=lambda: F.col("submission_channel"))
    days: Column = field(default_factory=lambda: F.col("processing_days"))
    flagged_pct: Column = field(default_factory=lambda: F.col("provider_flagged_pct"))


def rule_score(claim: ClaimColumns | None = None) -> Column:
    """Explainable score from 0 to 100."""
    c = claim or ClaimColumns()
    zero = F.lit(0.0)

    def points(pairs):
        return _cases([(cond, F.lit(float(p))) for cond, p in pairs], zero)

    total = (
        F.lit(V.BASE_POINTS)
        + points([(c.amount > limit, p) for limit, p in V.AMOUNT_POINTS])
        + points([(c.flagged_pct > limit, p) for limit, p in V.FLAGGED_PCT_POINTS])
        + points([(c.days <= limit, p) for limit, p in V.DAYS_POINTS])
        + points([(c.channel == name, p) for name, p in V.CHANNEL_POINTS.items()])
        + points([(c.claim_type == name, p) for name, p in V.CLAIM_TYPE_POINTS.items()])
    )
    # Never null, and whole because all points are: no rounding is needed.
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))


def risk_factors(claim: ClaimColumns | None = None) -> Column:
    """array<struct<factor, impact, description>> in fixed order; never empty."""
    c = claim or ClaimColumns()

    def factor(fixed: tuple[str, ...], *values) -> Column:
        """The texts of a factor with the values between them."""
        name, impact, *texts = fixed
        parts = [F.lit(texts[0])]
        for value, text in zip(values, texts[1:], strict=True):
            parts += [value, F.lit(text)]
        return F.struct(F.lit(name).alias("factor"), F.lit(impact).alias("impact"), F.concat(*parts).alias("description"))

    amount = F.format_number(c.amount, 0)
    pct = c.flagged_pct.cast("double").cast("string")
    groups = [
        [(c.amount > 200_000, factor(V.FACTOR_HIGH_AMOUNT, amount)),
         (c.amount > 100_000, factor(V.FACTOR_AMOUNT, amount, c.claim_type))],
        [(c.flagged_pct > 30, factor(V.FACTOR_HISTORY, pct)), (c.flagged_pct > 15, factor(V.FACTOR_WATCH_LIST, pct))],
        [(c.days <= 3, factor(V.FACTOR_RAPID, c.days.cast("string")))],
        [(c.channel.isin("email", "agent"), factor(V.FACTOR_CHANNEL, c.channel))],
    ]
    standard = factor(V.FACTOR_STANDARD)
    # Joined lists stay inside generated code; filtering one list would leave it.
    nothing = F.filter(F.array(standard), lambda f: F.lit(False))
    found = [_cases([(cond, F.array(f)) for cond, f in group], nothing) for group in groups]
    any_found = reduce(lambda a, b: a | b, [
        F.coalesce(cond, F.lit(False)) for group in groups for cond, _ in group])
    return F.concat(*found, F.when(any_found, nothing).otherwise(F.array(standard)))


REQUIRED_FIELDS = {
    "claim_type": "string", "claim_amount_hkd": "double", "region": "string",
    "provider_type": "string", "submission_channel": "string",
    "processing_days": "long", "provider_flagged_pct": "double",
}


def request_problems() -> Column:
    """array<string> of reasons a scoring request must be refused; empty when valid."""
    missing = [F.when(F.col(name).isNull(), F.lit(f"{name} is required")) for name in REQUIRED_FIELDS]
    ranges = [
        F.when(F.col("claim_amount_hkd") < 0, F.lit("claim_amount_hkd below 0")),
        F.when(F.col("processing_days") < 1, F.lit("processing_days below 1")),
        F.when(F.col("processing_days") > 90, F.lit("processing_days above 90")),
        F.when(F.col("provider_flagged_pct") < 0, F.lit("provider_flagged_pct below 0")),
        F.when(F.col("provider_flagged_pct") > 80, F.lit("provider_flagged_pct above 80")),
    ]
    return F.filter(F.array(*missing, *ranges), lambda reason: reason.isNotNull())
