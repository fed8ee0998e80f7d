"""Policy evaluation as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALLOWED, DISALLOWED, EXCLUDED, NOT_APPLICABLE = 0, 1, 2, 3  # fixed values of the answer


def duplicate_attributes(allowed_cas: Column, allowed: Column, disallowed: Column, excluded: Column) -> Column:
    """Whether a CA occurs twice, or a label twice over the three lists."""
    some = lambda x: F.coalesce(x, F.array().cast("array<string>"))
    labels = F.concat(some(allowed), some(disallowed), some(excluded))
    twice = lambda x: F.size(F.array_distinct(x)) < F.size(x)
    return twice(some(allowed_cas)) | twice(labels)


def check_domain(policy_domain: Column, name: Column, allowed: Column, disallowed: Column, excluded: Column) -> Column:
    """What a policy for ``policy_domain`` says of ``name``.

    The label next to the policy's domain decides: an exact entry first, then ``*``,
    each in the order allowed, disallowed, excluded; allowed if no list has it.
    """
    base, bare = F.regexp_replace(policy_domain, r"\.$", ""), F.regexp_replace(name, r"\.$", "")
    tail = F.concat(F.lit("."), base)
    label = F.element_at(F.split(F.substring(bare, F.lit(1), F.length(bare) - F.length(tail)), r"\."), -1)
    has = lambda x, y: F.coalesce(F.array_contains(x, y), F.lit(False))
    out = F.when(~F.endswith(bare, tail) | (F.length(bare) <= F.length(tail)), NOT_APPLICABLE)
    for what in (label, F.lit("*")):
        for lst, answer in ((allowed, ALLOWED), (disallowed, DISALLOWED), (excluded, EXCLUDED)):
            out = out.when(has(lst, what), answer)
    return out.otherwise(ALLOWED)


def issuer_allows(issuer_domain: Column, issuer_from: Column, issuer_to: Column, domain: Column, not_before: Column, not_after: Column) -> Column:
    """A child's validity lies in its issuer's, and its domain under the issuer's (any, if that is empty)."""
    inside = (not_before >= issuer_from) & (not_after <= issuer_to)
    under = (F.coalesce(issuer_domain, F.lit("")) == "") | (domain == issuer_domain) | F.endswith(domain, F.concat(F.lit("."), issuer_domain))
    return inside & under
