"""Domain-name algebra as native expressions.

Public suffixes are given by :class:`Rules`.  The default rules say: every two-letter
name is one (a country), so are the generic names, the second-level names that the
registries of some countries use, and all names right under some countries, but for
exceptions.  The whole public suffix list can be read from its file instead
(:func:`read_rules`); :func:`with_suffix` then looks names up by a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Generic names, and the second-level names of countries' registries.
GENERIC = [
    "com", "net", "org", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "aero", "coop", "museum", "mobi", "jobs", "travel", "cat",
    "tel", "asia", "post", "app", "dev", "xyz", "online", "site", "shop", "store", "cloud", "tech", "blog", "club", "live", "news", "wiki", "test",
]
SECOND = {
    "uk": "ac co gov ltd me net nhs org plc police sch", "au": "asn com edu gov id net org", "jp": "ac ad co ed go gr lg ne or",
    "br": "art com edu eng gov net org", "cn": "ac com edu gov mil net org", "in": "ac co edu firm gen gov ind net org res", "nz": "ac co gen geek govt iwi net org school",
    "kr": "ac co go ne or pe re", "mx": "com edu gob net org", "za": "ac co gov law net nom org web", "gr": "com edu gov net org", "tr": "av com edu gov k12 net org",
    "ar": "com edu gob int mil net org tur", "il": "ac co gov k12 muni net org", "tw": "club com edu gov idv net org", "hk": "com edu gov idv net org", "sg": "com edu gov net org per",
    "my": "com edu gov mil name net org", "id": "ac co desa go mil net or sch web", "th": "ac co go in mi net or", "ua": "com edu gov in net org", "pl": "com edu gov net org",
    "es": "com edu gob nom org", "pt": "com edu gov int net nome org publ", "eg": "com edu eun gov mil name net org sci", "ng": "com edu gov mil mobi name net org sch", "ke": "ac co go info me mobi ne or sc",
    "pe": "com edu gob mil net nom org", "co": "com edu gov mil net nom org", "ve": "co com edu gob info mil net org web", "ph": "com edu gov mil net ngo org", "vn": "ac com edu gov info name net org pro",
}
# Countries under which every name is a suffix, and the exceptions.
ALL_UNDER = ["bd", "ck", "er", "fk", "jm", "kh", "mm", "np", "pg"]
EXCEPTIONS = ["www.ck"]


@dataclass(frozen=True)
class Rules:
    """Suffixes, names under which every label makes one, exceptions, and whether all two-letter names are suffixes."""

    suffixes: frozenset = frozenset([*GENERIC, *[f"{x}.{cc}" for cc, names in SECOND.items() for x in names.split()]])
    all_under: frozenset = frozenset(ALL_UNDER)
    exceptions: frozenset = frozenset(EXCEPTIONS)
    countries: bool = True

    def contains(self, name: Column) -> Column:
        """Whether a name is a public suffix."""
        out = name.isin(sorted(self.suffixes))
        if self.countries:
            out = out | name.rlike("^[a-z]{2}$")
        if self.all_under:
            under = F.split(name, r"\.", 2)
            out = out | ((F.size(under) == 2) & F.element_at(under, -1).isin(sorted(self.all_under)) & ~F.contains(F.element_at(under, 1), F.lit(".")))
        return F.coalesce(out & ~name.isin(sorted(self.exceptions)) if self.exceptions else out, F.lit(False))


DEFAULT = Rules()
SUFFIXES = DEFAULT
_LABEL = r"^(\*|[A-Za-z0-9]|[A-Za-z0-9][A-Za-z0-9-]{0,61}[A-Za-z0-9])$"


def read_rules(path: str) -> Rules:
    """The rules of the registry section of a public suffix list file."""
    plain, under, other, section = set(), set(), set(), False
    with open(path, encoding="utf-8") as f:
        for line in map(str.strip, f):
            if "===BEGIN ICANN" in line or "===END ICANN" in line:
                section = "BEGIN" in line
            elif section and line and not line.startswith("//"):
                rule = line.split()[0].encode("idna").decode() if not line.isascii() and "*" not in line else line.split()[0]
                if rule.startswith("!"):  # the name is none, the one above it is
                    other.add(rule[1:])
                    plain.add(rule.split(".", 1)[1])
                elif rule.startswith("*."):
                    under.add(rule[2:])
                else:
                    plain.add(rule)
    return Rules(frozenset(plain), frozenset(under), frozenset(other), countries=False)


def rules_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """``rule, kind`` of the rules, for :func:`with_suffix`."""
    rows = [(x, k) for k, xs in (("plain", rules.suffixes), ("under", rules.all_under), ("except", rules.exceptions)) for x in sorted(xs)]
    return spark.createDataFrame(rows or [("", "plain")], "rule string, kind string")


def with_suffix(names: DataFrame, rules: DataFrame) -> DataFrame:
    """``name, suffix`` of ``names(name)``: the longest public suffix by ``rules(rule, kind)``, null if there is none.

    Each name's tails meet the rules in a join, so a list of any size costs a lookup
    for each label.
    """
    labels = F.split("name", r"\.")
    tails = names.select("name").distinct().select("name", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, F.size(labels) - i + 1, i), "."))).alias("k", "tail"))
    above = F.when(F.contains("tail", F.lit(".")), F.regexp_replace("tail", r"^[^.]*\.", ""))
    asked = tails.select("name", "k", "tail", F.col("tail").alias("rule"), F.lit("plain").alias("as")).unionByName(tails.select("name", "k", "tail", above.alias("rule"), F.lit("under").alias("as")).where("rule is not null")).unionByName(tails.select("name", "k", "tail", F.col("tail").alias("rule"), F.lit("except").alias("as")))
    met = asked.join(rules, (asked["rule"] == rules["rule"]) & (asked["as"] == rules["kind"])).groupBy("name", "k", "tail").agg(F.max(F.col("kind") == "except").alias("no"))
    best = met.where("not no").groupBy("name").agg(F.max_by("tail", "k").alias("suffix"))
    return names.select("name").distinct().join(best, "name", "left")


def _is_suffix(name: Column, suffixes) -> Column:
    return suffixes.contains(name) if isinstance(suffixes, Rules) else name.isin(list(suffixes))


def is_valid(name: Column, suffixes=SUFFIXES) -> Column:
    """At most one leading wildcard label, 255 characters, fine labels, and not itself a suffix."""
    labels = F.split(name, r"\.")
    return F.coalesce(name.rlike(r"^(\*\.)?[^*]*$") & (F.length(name) <= 255) & ~_is_suffix(name, suffixes) & F.forall(labels, lambda x: x.rlike(_LABEL)), F.lit(False))


def strip(name: Column) -> Column:
    """Without one leading ``*.`` and then one leading ``www.``."""
    bare = F.when(F.length(name) > 2, F.regexp_replace(name, r"^\*\.", "")).otherwise(name)
    return F.when(F.length(bare) > 4, F.regexp_replace(bare, r"^www\.", "")).otherwise(bare)


def suffix_labels(name: Column, suffixes=SUFFIXES) -> Column:
    """Number of labels of the longest public suffix of a name, 0 if none."""
    labels = F.split(name, r"\.")
    n = F.size(labels)
    tails = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(_is_suffix(F.array_join(F.slice(labels, n - i + 1, i), "."), suffixes), i).otherwise(0))
    return F.array_max(tails)


def e2ld(name: Column, suffixes=SUFFIXES) -> Column:
    """The public suffix and one label more; the whole name if it has no such suffix."""
    labels, k = F.split(name, r"\."), suffix_labels(name, suffixes)
    n = F.size(labels)
    return F.when((k > 0) & (n > k), F.array_join(F.slice(labels, n - k, k + 1), ".")).otherwise(name)


def split_e2ld(name: Column, suffixes=SUFFIXES) -> Column:
    """Labels before the e2LD, and then the e2LD."""
    labels, base = F.split(name, r"\."), e2ld(name, suffixes)
    return F.concat(F.slice(labels, F.lit(1), F.size(labels) - F.size(F.split(base, r"\."))), F.array(base))


def ancestors(name: Column, suffixes=SUFFIXES) -> Column:
    """From the e2LD to the full (stripped) name; null for an invalid name."""
    bare = strip(name)
    labels = F.split(bare, r"\.")
    n, base = F.size(labels), F.size(F.split(e2ld(bare, suffixes), r"\."))
    return F.when(is_valid(name, suffixes), F.transform(F.sequence(base, n), lambda i: F.array_join(F.slice(labels, n - i + 1, i), ".")))


def unique_valid(names: Column, suffixes=SUFFIXES) -> Column:
    """Distinct stripped valid names of an array."""
    return F.array_distinct(F.transform(F.filter(names, lambda x: is_valid(x, suffixes)), strip))


def common_suffixes(names: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """``e2ld, n_names, common`` of ``names(name)``: the longest common run of trailing labels per e2LD.

    The least and the greatest of the reversed names span the rest, so two
    aggregates do and no group is gathered.
    """
    back = F.array_join(F.reverse(F.split("name", r"\.")), "\x00")
    rows = names.select("name").where(is_valid(F.col("name"), suffixes)).select(strip(F.col("name")).alias("name")).distinct()
    rows = rows.withColumn("e2ld", e2ld(F.col("name"), suffixes)).withColumn("b", back)
    g = rows.groupBy("e2ld").agg(F.count("*").alias("n_names"), F.min("b").alias("lo"), F.max("b").alias("hi"))
    lo, hi = F.split("lo", "\x00"), F.split("hi", "\x00")
    pairs = F.arrays_zip(lo.alias("l"), hi.alias("h"))
    same = F.aggregate(pairs, F.lit(0), lambda k, p: F.when((k >= 0) & (p["l"] == p["h"]), k + 1).otherwise(F.when(k > 0, -k).otherwise(k)), lambda k: F.abs(k))
    return g.select("e2ld", "n_names", F.array_join(F.reverse(F.slice(lo, F.lit(1), same)), ".").alias("common"))


def affected(names: DataFrame, few: int = 4, suffixes=SUFFIXES) -> DataFrame:
    """``name``: the names themselves if there are few, else the common suffix of each e2LD."""
    rows = names.select("name").where(is_valid(F.col("name"), suffixes)).select(strip(F.col("name")).alias("name")).distinct()
    if rows.limit(few + 1).count() <= few:
        return rows
    return common_suffixes(names, suffixes).select(F.col("common").alias("name"))
