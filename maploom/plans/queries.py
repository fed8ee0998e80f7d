"""Queries over the driver's tables, one for each operator, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import domains as dn
from ..functions import ids, policies, times
from ..operators import coalesce as co
from ..operators import intervals, lookup, serving, smt
from ..operators.closure import ancestors, descendants
from ..sources import bundles
from ..store import Store, cut, shared_dir, upsert_ignore, upsert_replace
from . import fixture as fx
from .fixture import table, with_

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _coalesced(spark, sf_dir):
    out = co.glue(fx.linked(spark, sf_dir), fx.issuers(spark, sf_dir), lists=False)
    return out.select(F.sha2("domain", 256).alias("domain_id"), "n_certs", "cert_ids_id", "n_policies", "policy_ids_id", "leaf_value")


_CLOSURE = """c0 AS (SELECT domain_id, d.id, parent FROM domain_certs d JOIN certs USING (id) UNION SELECT c0.domain_id, certs.id, certs.parent FROM c0 JOIN certs ON certs.id = c0.parent),
ca AS (SELECT domain_id, count(*) AS n_certs, string_agg(id, '' ORDER BY id) AS cert_ids, list(id) AS l FROM (SELECT DISTINCT domain_id, id FROM c0) GROUP BY domain_id),
p0 AS (SELECT domain_id, d.id, parent FROM domain_policies d JOIN policies USING (id) UNION SELECT p0.domain_id, policies.id, policies.parent FROM p0 JOIN policies ON policies.id = p0.parent),
pa AS (SELECT domain_id, count(*) AS n_policies, string_agg(id, '' ORDER BY id) AS policy_ids, list(id) AS l FROM (SELECT DISTINCT domain_id, id FROM p0) GROUP BY domain_id),
out AS MATERIALIZED (SELECT domain_id, cert_ids, coalesce(n_certs, 0) AS n_certs, sha256(unhex(cert_ids)) AS cert_ids_id, policy_ids, coalesce(n_policies, 0) AS n_policies, sha256(unhex(policy_ids)) AS policy_ids_id,
  CASE WHEN cert_ids IS NOT NULL OR policy_ids IS NOT NULL THEN sha256(unhex(array_to_string(list_sort(list_distinct(list_concat(coalesce(ca.l, []), coalesce(pa.l, [])))), ''))) END AS leaf_value
  FROM dirty LEFT JOIN ca USING (domain_id) LEFT JOIN pa USING (domain_id))"""
_COALESCED = with_("certs", "domain_certs", "policies", "domain_policies", "dirty", more=_CLOSURE, recursive=True)


@query(_COALESCED + " SELECT domain_id, n_certs, cert_ids_id, n_policies, policy_ids_id, leaf_value FROM out")
def coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closure, ordered concatenation and digests of each dirty domain."""
    return _coalesced(spark, sf_dir)


@query(_COALESCED + " SELECT sha256(domain_id) AS key, leaf_value AS value FROM out WHERE leaf_value IS NOT NULL")
def smt_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie's input."""
    return _leaves(spark, sf_dir)


def _leaves(spark, sf_dir):
    out = _coalesced(spark, sf_dir).where("leaf_value is not null")
    return out.select(F.sha2("domain_id", 256).alias("key"), F.col("leaf_value").alias("value"))


_KEYS = with_("domain_certs", "domain_policies", more="k AS (SELECT sha256(domain_id) AS key FROM (SELECT domain_id FROM domain_certs UNION SELECT domain_id FROM domain_policies))")


def _keys(spark, sf_dir):
    return fx.domain_certs(spark, sf_dir).select("domain_id").union(fx.domain_policies(spark, sf_dir).select("domain_id")).distinct().select(F.sha2("domain_id", 256).alias("key"))


@query(_KEYS + " SELECT substr(key, 1, 2) AS prefix, count(*) AS n, min(key) AS lo, max(key) AS hi FROM k GROUP BY 1")
def smt_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: keys split by their first bits."""
    return _keys(spark, sf_dir).groupBy(F.substring("key", 1, 2).alias("prefix")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))


@query(_KEYS + """, nb AS (SELECT key, lag(key) OVER (ORDER BY key) AS a, lead(key) OVER (ORDER BY key) AS b FROM k)
SELECT key, greatest(CASE WHEN a IS NULL THEN 0 ELSE list_sum([CASE WHEN substr(key, 1, i) = substr(a, 1, i) THEN 1 ELSE 0 END FOR i IN range(1, 65)]) END,
 CASE WHEN b IS NULL THEN 0 ELSE list_sum([CASE WHEN substr(key, 1, i) = substr(b, 1, i) THEN 1 ELSE 0 END FOR i IN range(1, 65)]) END)::BIGINT AS shared_digits FROM nb""")
def smt_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: how deep a leaf lies, in hex digits that it shares with a neighbour; neighbours within a prefix of 8 bits."""
    keys = _keys(spark, sf_dir)
    w = Window.partitionBy(F.substring("key", 1, 2)).orderBy("key")
    rows = keys.select("key", F.lag("key").over(w).alias("a"), F.lead("key").over(w).alias("b"))
    # across prefixes only the first digit can agree: whether another prefix has it
    firsts = keys.groupBy(F.substring("key", 1, 1).alias("first")).agg(F.countDistinct(F.substring("key", 1, 2)).alias("prefixes"))
    rows = rows.withColumn("first", F.substring("key", 1, 1)).join(F.broadcast(firsts), "first")  # 16 rows
    same = lambda o: F.coalesce(F.size(F.filter(F.sequence(F.lit(1), F.lit(64)), lambda i: F.substring(F.col("key"), F.lit(1), i) == F.substring(F.col(o), F.lit(1), i))), F.lit(0))
    near = F.when(F.col("prefixes") > 1, 1).otherwise(0)
    return rows.select("key", F.greatest(F.when(F.col("a").isNull(), 0).otherwise(same("a")), F.when(F.col("b").isNull(), 0).otherwise(same("b")), near).cast("long").alias("shared_digits"))


_BITS = "array_to_string([lpad(bin(('0x' || substr({0}, 2 * i - 1, 2))::INT), 8, '0') FOR i IN range(1, 33)], '')"
_SAME = "list_sum([CASE WHEN substr({0}, 1, i) = substr({1}, 1, i) THEN 1 ELSE 0 END FOR i IN range(1, 65)])"
_TREE = _COALESCED + f""", lv AS MATERIALIZED (SELECT sha256(domain_id) AS key, leaf_value AS value, {_BITS.format("sha256(domain_id)")} AS bits FROM out WHERE leaf_value IS NOT NULL),
nb AS MATERIALIZED (SELECT *, lag(bits) OVER w AS p1, lead(bits) OVER w AS n1, lead(bits, 2) OVER w AS n2 FROM lv WINDOW w AS (ORDER BY key))"""


@query(_TREE + f""", deep AS (SELECT key, value, bits, CASE WHEN p1 IS NULL AND n1 IS NULL THEN 0 ELSE 1 + greatest(coalesce({_SAME.format("bits", "p1")}, 0), coalesce({_SAME.format("bits", "n1")}, 0)) END AS d FROM nb),
node AS (SELECT 64 AS level, substr(bits, 1, d::INT) AS pre, sha256(unhex(key) || unhex(value) || unhex(printf('%02x', (256 - d::INT) % 256))) AS h FROM deep
 UNION ALL SELECT level - 1, pre, h FROM (SELECT min(level) AS level, CASE WHEN length(pre) = level THEN substr(pre, 1, level - 1) ELSE pre END AS pre,
   CASE WHEN min(length(pre)) = min(level) THEN sha256(coalesce(min(unhex(h)) FILTER (substr(pre, level, 1) = '0'), unhex('00')) || coalesce(min(unhex(h)) FILTER (substr(pre, level, 1) = '1'), unhex('00'))) ELSE min(h) END AS h
   FROM node WHERE level > 0 GROUP BY CASE WHEN length(pre) = level THEN substr(pre, 1, level - 1) ELSE pre END, length(pre) = level))
SELECT h AS root FROM node WHERE level = 0""")
def smt_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root of all leaves."""
    return spark.createDataFrame([(smt.root(cut(_leaves(spark, sf_dir))),)], "root string")


@query(_TREE + f""", q AS (SELECT key, true AS included FROM lv UNION ALL SELECT sha256('absent' || key), false FROM lv), qb AS (SELECT *, {_BITS.format("key")} AS qbits FROM q),
m AS (SELECT qb.key, included, qbits, nb.bits AS c0, p1 AS c1, n1 AS c2, n2 AS c3 FROM qb ASOF JOIN nb ON qb.key >= nb.key
 UNION ALL SELECT qb.key, included, qbits, bits, n1, n2, NULL FROM qb, nb WHERE p1 IS NULL AND qb.key < nb.key),
s AS (SELECT key, included, list_sort([CASE WHEN c IS NULL THEN -1 WHEN c = qbits THEN 256 ELSE {_SAME.format("qbits", "c")} END FOR c IN [c0, c1, c2, c3]], 'DESC') AS same FROM m)
SELECT key, included, (1 + same[2])::INT AS path_length, true AS valid FROM s""")
def smt_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs for every leaf and as many absent keys, verified."""
    leaves = cut(_leaves(spark, sf_dir))
    root = smt.root(leaves)
    absent = leaves.select(F.sha2(F.concat(F.lit("absent"), "key"), 256).alias("key"))
    out = smt.proofs(leaves.select("key").unionByName(absent), leaves)

    @F.pandas_udf("boolean")
    def valid(key, path, included, proof_key, proof_value):
        import pandas as pd

        return pd.Series([smt.verify_inclusion(root, list(p), k, v) if i else smt.verify_absence(root, list(p), k, pk, v) for k, p, i, pk, v in zip(key, path, included, proof_key, proof_value, strict=True)])

    return out.select("key", "included", F.size("path").alias("path_length"), valid("key", "path", "included", "proof_key", "proof_value").alias("valid"))


_PRUNE = with_("certs", "domain_certs", recursive=True, more="""gone AS (SELECT id FROM certs WHERE expiration < TIMESTAMP '{0}' UNION SELECT certs.id FROM certs JOIN gone ON certs.parent = gone.id)
SELECT (SELECT count(*) FROM gone) AS removed, (SELECT count(*) FROM certs WHERE id NOT IN (SELECT id FROM gone)) AS remaining, (SELECT count(DISTINCT domain_id) FROM domain_certs WHERE id IN (SELECT id FROM gone)) AS dirty""")


def _prune(spark, sf_dir, when):
    rest, gone, dirty = co.prune(fx.certs(spark, sf_dir), fx.domain_certs(spark, sf_dir), F.lit(when).cast("timestamp_ntz"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(gone, "removed").join(one(rest, "remaining")).join(one(dirty, "dirty"))


@query(_PRUNE.format("1995-04-20"))
def prune_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before any authority expires."""
    return _prune(spark, sf_dir, "1995-04-20")


@query(_PRUNE.format("1998-06-01"))
def prune_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expired authorities take all below them."""
    return _prune(spark, sf_dir, "1998-06-01")


@query(with_("certs", "domain_certs", recursive=True, more="""gone AS (SELECT id FROM certs WHERE expiration < TIMESTAMP '1998-06-01' UNION SELECT certs.id FROM certs JOIN gone ON certs.parent = gone.id)
SELECT id AS cert_id FROM gone"""))
def descendant_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6, X2."""
    c = fx.certs(spark, sf_dir)
    return descendants(c, c.where("expiration < timestamp_ntz '1998-06-01'")).select(F.col("id").alias("cert_id"))


@query(with_("policies", recursive=True, more="a AS (SELECT id, id AS ancestor, parent FROM policies UNION SELECT a.id, p.id, p.parent FROM a JOIN policies p ON p.id = a.parent) SELECT id, ancestor FROM a"))
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, J3, X1."""
    p = fx.policies(spark, sf_dir)
    return ancestors(p, p)


@query("SELECT ('0x' || substr(sha256('d' || p_partkey || '.example.com'), 1, 2))::INT >> 3 AS shard, ('0x' || substr(sha256('d' || p_partkey || '.example.com'), 63, 2))::INT >> 3 AS low_shard, count(*) AS n FROM part GROUP BY ALL")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5, R10."""
    d = table(spark, sf_dir, "part").select(F.sha2(F.concat(F.lit("d"), F.col("p_partkey").cast("string"), F.lit(".example.com")), 256).alias("id"))
    return d.groupBy(ids.shard(F.col("id")).alias("shard"), ids.shard_low(F.col("id")).alias("low_shard")).agg(F.count("*").alias("n"))


def _asked(spark, sf_dir):
    """Ids of certificates that are there and of others, with their places."""
    li = table(spark, sf_dir, "supplier")
    return li.select(F.col("s_suppkey").alias("pos"), F.when(F.col("s_suppkey") % 3 == 0, F.sha2(F.concat(F.lit("none"), F.col("s_suppkey").cast("string")), 256)).otherwise(F.sha2(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")), 256)).alias("id"))


_ASKED = "asked AS (SELECT s_suppkey AS pos, CASE WHEN s_suppkey % 3 = 0 THEN sha256('none' || s_suppkey) ELSE sha256('supplier:' || s_suppkey) END AS id FROM supplier)"


@query(with_("certs", more=_ASKED) + " SELECT pos, id, id IN (SELECT id FROM certs) AS present FROM asked")
def certs_exist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence of ids."""
    return lookup.presence(_asked(spark, sf_dir), fx.certs(spark, sf_dir))


@query(with_("certs", more=_ASKED) + " SELECT string_agg(CASE WHEN id IN (SELECT id FROM certs) THEN '1' ELSE '0' END, '' ORDER BY pos) AS bits FROM asked")
def presence_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    return lookup.presence_bits(lookup.presence(_asked(spark, sf_dir), fx.certs(spark, sf_dir)))


@query("WITH " + _ASKED + (" SELECT pos, id, s_name AS payload FROM asked LEFT JOIN (SELECT sha256('supplier:' || s_suppkey) AS id, s_name FROM supplier UNION SELECT sha256('customer:' || c_custkey), c_name FROM customer) USING (id)"))
def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of ids in order, from two tables."""
    one = lambda t, k, n, p: table(spark, sf_dir, t).select(F.sha2(F.concat(F.lit(p), F.col(k).cast("string")), 256).alias("id"), F.col(n).alias("payload"))
    return lookup.payloads_in_order(_asked(spark, sf_dir), one("supplier", "s_suppkey", "s_name", "supplier:"), one("customer", "c_custkey", "c_name", "customer:"))


_DOMAIN = "SELECT sha256('d' || p_partkey || '.example.com') AS domain_id, p_partkey % 3 = 0 AS coalesced FROM part"


def _dirty_table(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.sha2(F.concat(F.lit("d"), F.col("p_partkey").cast("string"), F.lit(".example.com")), 256).alias("domain_id"), (F.col("p_partkey") % 3 == 0).alias("coalesced"))


@query(f"SELECT count(*) AS n_dirty, count(*) FILTER (NOT coalesced) AS n_open FROM ({_DOMAIN})")
def dirty_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    return co.dirty_counts(_dirty_table(spark, sf_dir))


@query(f"SELECT domain_id, shard, nth FROM (SELECT domain_id, ('0x' || substr(domain_id, 1, 2))::INT >> 3 AS shard, row_number() OVER (PARTITION BY ('0x' || substr(domain_id, 1, 2))::INT >> 3 ORDER BY domain_id) AS nth FROM ({_DOMAIN}) WHERE NOT coalesced) WHERE nth <= 5")
def dirty_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1, O2: the first five open domains of each shard."""
    return lookup.open_chunk(_dirty_table(spark, sf_dir), 5)


_PAYLOADS = "pl AS (SELECT sha256('d' || p_partkey || '.example.com') AS domain_id, p_name AS payload FROM part WHERE p_partkey % 7 <> 0)"


def _payload_table(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select(F.sha2(F.concat(F.lit("d"), F.col("p_partkey").cast("string"), F.lit(".example.com")), 256).alias("domain_id"), F.col("p_name").alias("payload"))


@query(f"WITH {_PAYLOADS} SELECT domain_id, payload FROM ({_DOMAIN}) LEFT JOIN pl USING (domain_id)")
def dirty_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9, J10."""
    return lookup.dirty_bundle(_dirty_table(spark, sf_dir), _payload_table(spark, sf_dir))


@query(f"WITH {_PAYLOADS} SELECT domain_id, payload FROM pl WHERE domain_id IN (SELECT domain_id FROM ({_DOMAIN}) WHERE coalesced)")
def domain_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11, J12, J14."""
    return lookup.entries(_dirty_table(spark, sf_dir).where("coalesced"), _payload_table(spark, sf_dir))


@query(f"WITH {_PAYLOADS} SELECT domain_id FROM ({_DOMAIN}) WHERE domain_id NOT IN (SELECT domain_id FROM pl)")
def orphan_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15, K10."""
    d = _dirty_table(spark, sf_dir)
    return lookup.orphans(d.select("domain_id"), _payload_table(spark, sf_dir), d)


@query("SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 2 <> 0 AND c_custkey % 3 = 0")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1-K3, K5: first writer wins."""
    c = table(spark, sf_dir, "customer")
    return upsert_ignore(c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.lit("new").alias("v")), ["k"])


@query("SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0")
def replace_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last writer wins."""
    c = table(spark, sf_dir, "customer")
    return upsert_replace(c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.lit("new").alias("v")), ["k"])


_MERGED = """o AS (SELECT *, max("end") OVER (PARTITION BY log ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM bundles),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY log ORDER BY start) AS g FROM o),
merged AS (SELECT log, min(start) AS start, max("end") AS "end" FROM g GROUP BY log, g.g)"""


@query(with_("bundles", more=_MERGED) + ' SELECT log, start, "end" FROM merged')
def merged_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    return intervals.merge(fx.bundles(spark, sf_dir), "log")


@query(with_("bundles", more=_MERGED) + """ SELECT log, start, "end" FROM bundles b WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.log = b.log AND m.start % 200 = 0 AND m.start <= b.start AND m."end" >= b."end")""")
def pending_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles that no completed interval (here every second) covers."""
    b = fx.bundles(spark, sf_dir)
    return intervals.pending(b, intervals.merge(b, "log").where("start % 200 = 0"), "log")


@query(with_("bundles", more=_MERGED) + ' SELECT log, "end" + 1 AS size FROM merged WHERE start = 0')
def reachable_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far contiguous bundles reach from 0."""
    return intervals.reachable(fx.bundles(spark, sf_dir), "log", 0)


@query("""WITH w AS (SELECT c_nationkey AS idx, count(*) AS weight FROM customer GROUP BY 1), x AS (SELECT idx, weight * 1000 // (SELECT sum(weight) FROM w)::BIGINT AS base, weight * 1000 % (SELECT sum(weight) FROM w)::BIGINT AS rest FROM w)
SELECT idx, (base + CASE WHEN row_number() OVER (ORDER BY rest DESC, idx) <= 1000 - (SELECT sum(base) FROM x) THEN 1 ELSE 0 END)::BIGINT AS share FROM x""")
def apportionment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest remainders (the weights are a bounded table of 25 nations)."""
    w = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("idx")).agg(F.count("*").alias("weight"))
    return intervals.apportion(w, 1000)


@query("""WITH w AS (SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 50 AS batch FROM events)
SELECT user_id, batch::BIGINT AS batch, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM w GROUP BY ALL""")
def count_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of fifty."""
    e = lookup.count_windows(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 50)
    return e.groupBy("user_id", "batch").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("""WITH c AS (SELECT 'leaf' || s_suppkey AS leaf, 'mid' || (s_suppkey % 25) AS mid, 'top' || (s_suppkey % 5) AS top, s_name FROM supplier)
SELECT leaf AS cert_id, mid AS parent_id, 0 AS level, s_name AS names FROM c UNION ALL SELECT DISTINCT mid, top, 1, NULL FROM c UNION ALL SELECT DISTINCT top, NULL, 2, NULL FROM c""")
def unfolded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certificates of chains, without repeats."""
    s = table(spark, sf_dir, "supplier")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    chains = s.select(text("leaf", F.col("s_suppkey")).alias("leaf"), F.col("s_name").alias("names"), F.array(text("mid", F.col("s_suppkey") % 25), text("top", F.col("s_suppkey") % 5)).alias("chain"))
    return lookup.unfold(chains)


_HOSTS = r"hosts AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS name FROM pages)"


def _hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("name")).distinct()


def _suffix(x: str) -> str:
    """SQL: whether x is a public suffix by the default rules."""
    some = lambda xs: "(" + ", ".join(f"'{s}'" for s in sorted(xs)) + ")"
    under = f"(len(string_split({x}, '.')) = 2 AND string_split({x}, '.')[2] IN {some(dn.DEFAULT.all_under)})"
    return f"(({x} IN {some(dn.DEFAULT.suffixes)} OR regexp_full_match({x}, '[a-z][a-z]') OR {under}) AND {x} NOT IN {some(dn.DEFAULT.exceptions)})"


_LABEL = r"'^(\*|[A-Za-z0-9]|[A-Za-z0-9][A-Za-z0-9-]{0,61}[A-Za-z0-9])$'"
_VALID = rf"(regexp_matches(name, '^(\*\.)?[^*]*$') AND length(name) <= 255 AND NOT {_suffix('name')} AND len([x FOR x IN string_split(name, '.') IF NOT regexp_matches(x, {_LABEL})]) = 0)"
_NAMES = _HOSTS + rf""",
s0 AS (SELECT name, {_VALID} AS valid, CASE WHEN length(name) > 2 THEN regexp_replace(name, '^\*\.', '') ELSE name END AS b0 FROM hosts),
s1 AS (SELECT name, valid, CASE WHEN length(b0) > 4 THEN regexp_replace(b0, '^www\.', '') ELSE b0 END AS bare FROM s0),
s2 AS (SELECT *, string_split(bare, '.') AS l, len(string_split(bare, '.')) AS n FROM s1),
s3 AS (SELECT *, coalesce(list_max([i FOR i IN range(1, n + 1) IF {_suffix("array_to_string(l[n-i+1:n], '.')")}]), 0) AS k FROM s2),
s4 AS (SELECT *, CASE WHEN k > 0 AND n > k THEN k + 1 ELSE n END AS base FROM s3)"""


@query("WITH " + _NAMES + " SELECT name, valid, array_to_string(l[n-base+1:n], '.') AS e2ld, CASE WHEN valid THEN array_to_string([array_to_string(l[n-i+1:n], '.') FOR i IN range(base, n + 1)], ' ') END AS ancestors FROM s4")
def domain_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity, e2LD and ancestors of host names; Q1's explosion."""
    name = F.col("name")
    up = dn.ancestors(name)
    return _hosts(spark, sf_dir).select("name", dn.is_valid(name).alias("valid"), dn.e2ld(dn.strip(name)).alias("e2ld"), F.when(up.isNotNull(), F.array_join(up, " ")).alias("ancestors"))


@query("WITH " + _NAMES + """, v AS (SELECT DISTINCT bare, l, n, array_to_string(l[n-base+1:n], '.') AS e2ld FROM s4 WHERE valid), g AS (SELECT e2ld, count(*) AS n_names, min(n) AS least FROM v GROUP BY 1),
c AS (SELECT e2ld, i, count(DISTINCT array_to_string(l[n-i+1:n], '.')) AS d FROM v JOIN g USING (e2ld), unnest(range(1, 40)) t(i) WHERE i <= least GROUP BY ALL),
m AS (SELECT e2ld, max(i) AS i FROM c WHERE d = 1 GROUP BY 1)
SELECT e2ld, n_names, min(array_to_string(l[n-i+1:n], '.')) AS common FROM v JOIN g USING (e2ld) JOIN m USING (e2ld) GROUP BY ALL""")
def common_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: longest common suffix of the names of each e2LD."""
    return dn.common_suffixes(_hosts(spark, sf_dir))


_LINES = "SELECT CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 7 = 0 THEN 'a,b,c' WHEN event_id % 5 = 0 THEN '0,1,2,\"c\",d,9.0' ELSE '0,1,2,cert' || event_id || ',x;y,san,' || (1700000000 + event_id) || CASE WHEN event_id % 3 = 0 THEN '' ELSE '.5' END END AS value FROM events"


@query(f"""WITH l AS ({_LINES}), f AS (SELECT value, string_split(value, ',') AS f FROM l), d AS (SELECT f, CASE WHEN value = '' THEN 'error' WHEN contains(value, '"') THEN 'fallback' WHEN len(f) < 5 OR f[4] = '' THEN 'error' WHEN NOT regexp_full_match(f[-1], '[0-9]+\\.[0-9]+') THEN 'fallback' ELSE 'ok' END AS disposition FROM f)
SELECT disposition, count(*) AS n, min(CASE WHEN disposition = 'ok' THEN f[4] END) AS first_cert, max(CASE WHEN disposition = 'ok' THEN f[-1] END) AS last_expiration FROM d GROUP BY 1""")
def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispositions of bundle lines."""
    i = F.col("event_id")
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    value = F.when(i % 11 == 0, "").when(i % 7 == 0, "a,b,c").when(i % 5 == 0, '0,1,2,"c",d,9.0')
    value = value.otherwise(text("0,1,2,cert", i.cast("string"), ",x;y,san,", (i + 1700000000).cast("string"), F.when(i % 3 == 0, "").otherwise(".5")))
    rows = bundles.split_lines(table(spark, sf_dir, "events").select(value.alias("value")))
    return rows.groupBy("disposition").agg(F.count("*").alias("n"), F.min("cert").alias("first_cert"), F.max("expiration").alias("last_expiration"))


@query("SELECT (i * 100) || '-' || (i * 100 + 99) || '.gz' AS name, i * 100 AS first, i * 100 + 99 AS last, 100::BIGINT AS n FROM (SELECT DISTINCT event_id // 100 AS i FROM events)")
def bundle_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices and row counts from file names."""
    i = F.floor(F.col("event_id") / 100)
    names = table(spark, sf_dir, "events").select(F.concat((i * 100).cast("string"), F.lit("-"), (i * 100 + 99).cast("string"), F.lit(".gz")).alias("name")).distinct()
    first, last = bundles.file_interval(F.col("name"))
    return names.select("name", first.alias("first"), last.alias("last")).withColumn("n", F.col("last") - F.col("first") + 1)


@query("""WITH p AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'a.example.com' WHEN 1 THEN 'x.b.example.com' WHEN 2 THEN 'other.org' ELSE 'c.example.com.' END AS name, c_nationkey % 5 AS m FROM customer)
SELECT c_custkey, (CASE WHEN c_custkey % 4 = 2 THEN 3 WHEN c_custkey % 4 = 0 THEN CASE WHEN m = 0 THEN 0 WHEN m = 1 THEN 1 WHEN m = 2 THEN 2 WHEN m = 3 THEN 1 ELSE 0 END
 WHEN m = 3 THEN 1 ELSE 0 END)::INT AS answer FROM p""")
def policy_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy evaluation: what a policy for example.com says of names."""
    k, m = F.col("c_custkey"), F.col("c_nationkey") % 5
    name = F.when(k % 4 == 0, "a.example.com").when(k % 4 == 1, "x.b.example.com").when(k % 4 == 2, "other.org").otherwise("c.example.com.")
    one = F.array(F.lit("a"))
    allowed, disallowed, excluded = F.when(m == 0, one), F.when(m == 1, one).when(m == 3, F.array(F.lit("*"))), F.when(m == 2, one)
    return table(spark, sf_dir, "customer").select(k, policies.check_domain(F.lit("example.com"), name, allowed, disallowed, excluded).cast("int").alias("answer"))


@query("""WITH t AS (SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN 'y' WHEN 1 THEN 'w' WHEN 2 THEN 'd' WHEN 3 THEN 'h' WHEN 4 THEN 'ms' ELSE 's' END AS u FROM customer)
SELECT k, (k % 200 + 1) * CASE u WHEN 'y' THEN 31536000000000000 WHEN 'w' THEN 604800000000000 WHEN 'd' THEN 86400000000000 WHEN 'h' THEN 3600000000000 WHEN 'ms' THEN 1000000 ELSE 1000000000 END AS ns FROM t""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration parsing."""
    k = F.col("c_custkey")
    unit = F.when(k % 6 == 0, "y").when(k % 6 == 1, "w").when(k % 6 == 2, "d").when(k % 6 == 3, "h").when(k % 6 == 4, "ms").otherwise("s")
    return table(spark, sf_dir, "customer").select(k.alias("k"), times.parse_duration(F.concat((k % 200 + 1).cast("string"), unit)).alias("ns"))


@query("SELECT event_type, count(*) AS n, round(median(value), 6) AS median, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.75), 6) AS q3 FROM events GROUP BY 1")
def benchmark_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and quartiles."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.median("value"), 6).alias("median"), F.round(F.percentile("value", 0.25), 6).alias("q1"), F.round(F.percentile("value", 0.75), 6).alias("q3"))


@query("""SELECT DISTINCT sha256('{"T":"*pc","O":{"Domain":"d' || c_custkey || '.example.com"}}') AS policy_id, 'pc' AS tag, true AS is_pointer, 'd' || c_custkey || '.example.com' AS domain FROM customer""")
def policy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged JSON documents; ids hash the raw bytes."""
    raw = F.concat(F.lit('{"T":"*pc","O":{"Domain":"d'), F.col("c_custkey").cast("string"), F.lit('.example.com"}}'))
    return bundles.tagged(table(spark, sf_dir, "customer").select(raw.alias("raw"))).drop("raw")


@query("SELECT sha256('log' || user_id) AS url_hash, max(event_id) + 1 AS size FROM events GROUP BY user_id")
def log_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last known size of each log."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg((F.max("event_id") + 1).alias("size")).select(F.sha2(F.concat(F.lit("log"), F.col("user_id").cast("string")), 256).alias("url_hash"), "size")


@query(with_("domain_certs", more="g AS (SELECT domain_id, string_agg(id, '' ORDER BY id) AS glued, count(*) AS n FROM domain_certs GROUP BY 1) SELECT domain_id, n, sha256(unhex(glued)) AS digest, substr(glued, 1, 64) AS first_id FROM g"))
def glued_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2, Q4: gluing ids and splitting them again."""
    g = fx.domain_certs(spark, sf_dir).groupBy("domain_id").agg(F.expr("listagg(id, '') WITHIN GROUP (ORDER BY id)").alias("glued"))
    parts = ids.split_ids(F.col("glued"))
    return g.select("domain_id", F.size(parts).cast("long").alias("n"), ids.list_digest(F.array_join(parts, "")).alias("digest"), F.element_at(parts, 1).alias("first_id"))


_PLAIN = _suffix("{0}").replace("OR regexp_full_match({0}, '[a-z][a-z]') ", "")


@query(f"""WITH {_HOSTS}, t AS (SELECT name, string_split(name, '.') AS l, len(string_split(name, '.')) AS n FROM hosts), k AS (SELECT name, l, n, list_max([i FOR i IN range(1, n + 1) IF {_PLAIN.format("array_to_string(l[n-i+1:n], '.')")}]) AS k FROM t)
SELECT name, CASE WHEN k IS NOT NULL THEN array_to_string(l[n-k+1:n], '.') END AS suffix FROM k""")
def suffix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public suffixes of host names by a join with the rules."""
    rules = dn.Rules(countries=False)
    return dn.with_suffix(_hosts(spark, sf_dir), dn.rules_table(spark, rules))


_IDS = "SELECT sha256('d' || p_partkey || '.example.com') AS domain_id, sha256('c' || p_partkey) AS cert_ids, sha256(unhex(sha256('c' || p_partkey))) AS cert_ids_id FROM part WHERE p_partkey % 7 <> 0"


@query(f"""WITH pl AS ({_IDS}) SELECT domain_id, coalesce(cert_ids_id, repeat('0', 64)) AS cert_ids_id, cert_ids, repeat('0', 64) AS policy_ids_id, NULL::VARCHAR AS policy_ids FROM ({_DOMAIN}) LEFT JOIN pl USING (domain_id)""")
def payload_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the payloads of domains, zero where there is none."""
    key = F.sha2(F.concat(F.lit("c"), F.col("p_partkey").cast("string")), 256)
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select(F.sha2(F.concat(F.lit("d"), F.col("p_partkey").cast("string"), F.lit(".example.com")), 256).alias("domain_id"), key.alias("cert_ids"), ids.list_digest(key).alias("cert_ids_id"), none.alias("policy_ids"), none.alias("policy_ids_id"))
    return serving.payload_ids(rows, _dirty_table(spark, sf_dir)).select("domain_id", "cert_ids_id", "cert_ids", "policy_ids_id", "policy_ids")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN s_name WHEN s_suppkey % 2 = 0 THEN 'san' || s_suppkey ELSE '' END AS subject FROM supplier")
def subject_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The common name, else the first other name that is not empty."""
    k = F.col("s_suppkey")
    cn = F.when(k % 3 > 0, F.col("s_name")).when(k % 2 == 0, "")
    names = F.when(k % 2 == 0, F.array(F.lit(""), F.concat(F.lit("san"), k.cast("string")))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", lookup.subject_name(cn, names).alias("subject"))


@query("""WITH RECURSIVE c AS (SELECT 's' || s_suppkey AS id, 's' || s_suppkey AS subject, 'n' || s_nationkey AS issuer FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'n' || n_nationkey, 'r' || n_regionkey FROM nation
 UNION ALL SELECT 'z' || n_nationkey, 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey, 'r' || r_regionkey FROM region),
a AS (SELECT id AS cert_id, id AS ancestor FROM c WHERE id[1] = 's' UNION SELECT a.cert_id, (SELECT min(p.id) FROM c p WHERE p.subject = x.issuer) FROM a JOIN c x ON x.id = a.ancestor WHERE x.issuer <> x.subject)
SELECT cert_id, ancestor FROM a WHERE ancestor IS NOT NULL""")
def issuer_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains by issuer and subject, up to self-signed certificates; of two with one subject the lesser id."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    leaves = s.select(name("s", "s_suppkey").alias("cert_id"), name("s", "s_suppkey").alias("subject"), name("n", "s_nationkey").alias("issuer"))
    mid = [n.select(name(p, "n_nationkey").alias("cert_id"), name("n", "n_nationkey").alias("subject"), name("r", "n_regionkey").alias("issuer")) for p in "nz"]
    top = r.select(name("r", "r_regionkey").alias("cert_id"), name("r", "r_regionkey").alias("subject"), name("r", "r_regionkey").alias("issuer"))
    return lookup.chains(leaves.unionByName(mid[0]).unionByName(mid[1]).unionByName(top), leaves)


@query("""SELECT c_custkey, (c_custkey % 10 >= 2 AND c_custkey % 10 + c_nationkey % 5 <= 9 AND c_custkey % 3 <> 2) AS allowed, (c_nationkey % 4 = 0) AS twice FROM customer""")
def policy_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issuer constraints, and repeated attributes: validity inside the issuer's, a name below its domain, none twice."""
    k, m = F.col("c_custkey") % 10, F.col("c_nationkey")
    domain = F.when(F.col("c_custkey") % 3 == 0, "a.com").when(F.col("c_custkey") % 3 == 1, "x.a.com").otherwise("xa.com")
    fine = policies.issuer_allows(F.lit("a.com"), F.lit(2), F.lit(9), domain, k, k + m % 5)
    one = F.array(F.lit("a"))
    twice = policies.duplicate_attributes(one, F.when(m % 4 == 0, F.array(F.lit("x"), F.lit("y"))), F.array(F.lit("x")), F.lit(None).cast("array<string>"))
    return table(spark, sf_dir, "customer").select("c_custkey", fine.alias("allowed"), twice.alias("twice"))


@query("""SELECT c_custkey % 1440 AS minute, count(*) AS n, (c_custkey % 1440) * 60 AS seconds, 86400 + CASE WHEN c_custkey % 1440 * 60 > 30000 THEN 0 ELSE 86400 END + c_custkey % 1440 * 60 AS next FROM customer GROUP BY ALL""")
def times_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of day and when they come next."""
    m = F.col("c_custkey") % 1440
    rows = table(spark, sf_dir, "customer").groupBy(m.alias("minute")).agg(F.count("*").alias("n"))
    text = F.format_string("%02d:%02d", F.floor(F.col("minute") / 60), F.col("minute") % 60)
    seconds = times.time_of_day(text)
    return rows.select("minute", "n", seconds.cast("long").alias("seconds"), times.to_seconds(times.next_time_of_day(times.from_seconds(F.lit(86400 + 30000)), seconds)).alias("next"))


@query("""SELECT sha256('d' || c_custkey) AS domain_id, CASE WHEN c_custkey % 2 = 0 THEN 'first' || c_nationkey ELSE 'second' || c_nationkey END AS name, c_custkey % 5 = 0 AS coalesced FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0""")
def stored_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writes to the store; names keep the first writer's, flags the last."""
    import uuid

    store = Store(spark, f"{shared_dir(spark)}/maploom/store-{uuid.uuid4().hex[:12]}")
    c = table(spark, sf_dir, "customer")
    key = F.sha2(F.concat(F.lit("d"), F.col("c_custkey").cast("string")), 256).alias("domain_id")
    for step, word in ((2, "first"), (3, "second")):
        some = c.where(F.col("c_custkey") % step == 0)
        store.ignore("domains", some.select(key, F.concat(F.lit(word), F.col("c_nationkey").cast("string")).alias("domain_name")))
        store.replace("dirty", some.select(key, F.lit(False).alias("coalesced")))
    store.replace("dirty", c.where("c_custkey % 5 = 0").where("c_custkey % 2 = 0 or c_custkey % 3 = 0").select(key, F.lit(True).alias("coalesced")))
    return store.read("domains").join(store.read("dirty"), "domain_id").select("domain_id", F.col("domain_name").alias("name"), "coalesced")
