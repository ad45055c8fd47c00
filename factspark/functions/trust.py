"""Trust, decay and independence expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .names import literal_map

# A host with its port, as written between "//" and the next "/", "?" or "#".
_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
NO_WINDOW_DAYS = 3650  # window of attributes without a volatility setting


def url_domain(url: Column) -> Column:
    """Lower-case authority of a URL without a leading ``www.``; '' when there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _AUTHORITY, 1))
    return F.regexp_replace(host, r"^www\.", "")


def domain_trust(url: Column) -> Column:
    host = url_domain(url)
    ending = F.lit(vocab.DEFAULT_TRUST)
    for suffix, trust in reversed(vocab.DOMAIN_ENDING_TRUST):
        ending = F.when(host.endswith(suffix), F.lit(trust)).otherwise(ending)
    return F.coalesce(literal_map(vocab.DOMAIN_TRUST, host), ending)


def document_domain(url: Column, source_domain: Column) -> Column:
    fallback = F.regexp_replace(F.lower(F.coalesce(source_domain, F.lit(""))), r"^www\.", "")
    return F.coalesce(F.nullif(url_domain(url), F.lit("")), fallback)


def effective_trust(trust_override: Column, base_trust: Column) -> Column:
    return F.coalesce(trust_override, base_trust)


def source_odds(trust: Column) -> Column:
    t = F.least(F.greatest(trust, F.lit(0)), F.lit(100)).cast("double")
    return t / F.greatest(F.lit(1.0), F.lit(100.0) - t)


def odds_to_confidence(odds: Column) -> Column:
    """Half-even rounded percentage, kept within 1..99."""
    share = F.lit(100.0) * (odds / (F.lit(1.0) + odds))
    return F.least(F.greatest(F.bround(share, 0), F.lit(1.0)), F.lit(99.0)).cast("int")


def combine_trust(base: Column, corroborants: Column) -> Column:
    """Confidence from a base trust and an array of independent confirming trusts."""
    odds = F.aggregate(
        F.coalesce(corroborants, F.array().cast("array<int>")),
        source_odds(base),
        lambda acc, t: acc * F.greatest(F.lit(1.0), source_odds(t)),
    )
    return odds_to_confidence(odds)


def single_source(base: Column) -> Column:
    """Confidence of a claim with one source only."""
    return odds_to_confidence(source_odds(base))


def relation_bump(confidence: Column, trust: Column) -> Column:
    gain = F.floor((F.lit(100) - confidence) * trust / F.lit(300.0)).cast("int")
    return F.least(F.lit(99), confidence + F.greatest(F.lit(3), gain)).cast("int")


def whole_days(later: Column, earlier: Column) -> Column:
    """Full days between two timestamps, rounded down (also below zero)."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86400000000)).cast("int")


def fractional_days(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86400000000.0)


def days_stale(effective_at: Column, volatility_days: Column, as_of: Column) -> Column:
    window = F.coalesce(volatility_days, F.lit(NO_WINDOW_DAYS))
    excess = F.greatest(F.lit(0), whole_days(as_of, effective_at) - window)
    return F.coalesce(excess, F.lit(0)).cast("int")


def periods_stale(effective_at: Column, volatility_days: Column, as_of: Column) -> Column:
    window = F.greatest(F.coalesce(volatility_days, F.lit(NO_WINDOW_DAYS)), F.lit(1))
    return F.bround(days_stale(effective_at, volatility_days, as_of) / window, 2)


def tenths(share: Column) -> Column:
    """A share from 0.1 to 1 rounded to one decimal by its exact binary value, halves to even.

    Times 2**56 it is a whole number, so no product or printed form decides a tie.
    """
    parts = (share * F.lit(2.0**56)).cast("bigint") * 10
    whole, rest = F.shiftright(parts, 56), parts.bitwiseAND(F.lit((1 << 56) - 1))
    up = rest * 2 + whole.bitwiseAND(F.lit(1).cast("bigint")) > F.lit(1 << 56)
    return (whole + up.cast("bigint")) / F.lit(10.0)


def display_trust(confidence: Column, effective_at: Column, volatility_days: Column, as_of: Column) -> Column:
    """Decayed trust between 0.1 and 1.0, one decimal."""
    penalty = F.least(F.lit(0.7), F.lit(0.05) * periods_stale(effective_at, volatility_days, as_of))
    kept = F.greatest(F.lit(0.1), F.least(F.lit(1.0), confidence / F.lit(100.0) - penalty))
    return tenths(kept)


def effective_confidence(confidence: Column, valid_from: Column, volatility_days: Column, as_of: Column) -> Column:
    """Confidence less a point per tenth of a window overrun, at most 30; no window, no loss."""
    window = volatility_days.cast("double")
    over = F.greatest(F.lit(0.0), fractional_days(as_of, valid_from) - window)
    steps = F.floor(over / F.greatest(window, F.lit(1.0)) * 10)
    loss = F.when(volatility_days.isNull(), F.lit(0)).otherwise(F.least(F.lit(30), steps).cast("int"))
    return F.greatest(confidence - loss, F.lit(0)).cast("int")


def documents_independent(a_id, a_hash, a_domain, b_id, b_hash, b_domain) -> Column:
    """Do two documents count as separate evidence?"""
    known = (F.coalesce(a_domain, F.lit("")) != "") & (F.coalesce(b_domain, F.lit("")) != "")
    return F.coalesce(
        a_id.isNotNull()
        & b_id.isNotNull()
        & (a_id != b_id)
        & ~F.coalesce(a_hash == b_hash, F.lit(False))
        & known
        & (a_domain != b_domain),
        F.lit(False),
    )


def ranges_overlap(a_lower, a_upper, b_lower, b_upper) -> Column:
    """Overlap of two half-open ranges; a null bound is unbounded."""
    open_range = (a_lower.isNull() & a_upper.isNull()) | (b_lower.isNull() & b_upper.isNull())
    left = a_lower.isNull() | b_upper.isNull() | (a_lower < b_upper)
    right = b_lower.isNull() | a_upper.isNull() | (b_lower < a_upper)
    return open_range | (left & right)


def should_reopen(rec_a, rec_b, cur_a, cur_b) -> Column:
    """Has the evidence grown enough to decide a rejected pair again?"""
    return (
        ((cur_a >= 3) & (rec_a < 3))
        | ((cur_b >= 3) & (rec_b < 3))
        | (cur_a - rec_a >= 3)
        | (cur_b - rec_b >= 3)
    )
