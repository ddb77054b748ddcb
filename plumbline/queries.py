"""Queries over the given tables, each with the SQL that it is held against.

The address views are one SQL text for both engines: streets, houses and cities are made from
customer and supplier keys, spelled differently on each side.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import address as A
from plumbline.functions import slots as S
from plumbline.functions import text as T
from plumbline.operators import collect, compare, matching, profile, reference, registry, sanitize
from plumbline.operators.assignment import assign
from plumbline.sources import cells as C
from plumbline.sources.scratch import settled, spread

#: Streets of the views.
STREETS = ("Ленина", "Садовая", "Центральная", "Мира", "Гагарина", "Лесная", "Школьная", "Заводская", "Победы", "Речная", "Южная", "Новая")
#: The same, lower-cased.
LOW = tuple(s.lower() for s in STREETS)


def _street(k: str, names=STREETS) -> str:
    return f"CASE {k} % 12 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(names)) + " END"


_A = "concat('г. Тюмень, ', CASE c_custkey % 3 WHEN 0 THEN 'ул. ' WHEN 1 THEN 'улица ' ELSE '' END, {street}, ', д. ', 1 + c_custkey % 40, CASE c_custkey % 7 WHEN 0 THEN ' корп. 2' WHEN 1 THEN ' кв. 5' ELSE '' END)"
_B = "concat('Город Тюмень УЛ ', {street}, ' ', 1 + s_suppkey % 53, CASE s_suppkey % 7 WHEN 0 THEN ' корпус 2' ELSE '' END)"
VIEWS = {
    "addr_a": f"SELECT c_custkey AS row_idx, {_A.format(street=_street('c_custkey'))} AS address, c_mktsegment AS payload, {_street('c_custkey', LOW)} AS sw, concat(1 + c_custkey % 40, '') AS hb, CASE c_custkey % 7 WHEN 0 THEN 'к2' ELSE '' END AS hm FROM {{customer}}",
    "addr_b": f"SELECT s_suppkey AS row_idx, {_B.format(street=_street('s_suppkey'))} AS address, s_name AS payload, {_street('s_suppkey', LOW)} AS sw, concat(1 + s_suppkey % 53, '') AS hb, CASE s_suppkey % 7 WHEN 0 THEN 'к2' ELSE '' END AS hm FROM {{supplier}}",
    "addr_blank": f"SELECT c_custkey AS row_idx, CASE WHEN c_custkey % 11 <> 0 THEN {_A.format(street=_street('c_custkey'))} END AS address, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS payload, CASE WHEN c_custkey % 5 <> 0 THEN {_street('c_custkey')} ELSE '' END AS street, CASE WHEN c_custkey % 4 <> 0 THEN concat(c_custkey % 40, '') END AS house FROM {{customer}}",
    "codes": "SELECT c_custkey AS row_idx, concat(substring(concat('00', c_nationkey), -2), substring(concat('000', c_custkey % 200), -3), substring(concat('000', c_custkey % 7), -3)) AS code FROM {customer}",
    "known": "SELECT concat(substring(concat('00', n_nationkey), -2)) AS code FROM {nation} UNION ALL SELECT DISTINCT concat(substring(concat('00', c_nationkey), -2), substring(concat('000', c_custkey % 200), -3)) FROM {customer} WHERE c_mktsegment <> 'FURNITURE'",
    "scopes": "SELECT n_nationkey AS scope, substring(concat('00', n_nationkey), -2) AS ter, 10 * n_regionkey AS lo, 10 * n_regionkey + 100 AS hi, 20 + n_nationkey AS no_lo, 30 + n_nationkey AS no_hi FROM {nation}",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in ("customer", "supplier", "nation")}
    return spark.sql(VIEWS[name].format(**tables))


def _duck(name: str) -> str:
    return VIEWS[name].format(customer="customer", supplier="supplier", nation="nation")


def _with(sql: str, *views: str) -> str:
    return "WITH " + ", ".join(f"{v} AS ({_duck(v)})" for v in views) + " " + sql


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(spark: SparkSession, sf_dir: str, name: str, dealt: bool = False) -> DataFrame:
    rows = view(spark, sf_dir, name)
    return (spread(rows, "row_idx") if dealt else rows).withColumn("key", T.building_key("address"))


#: The building key from the parts that addresses are made of, not from their texts: a key leaves out kinds and rooms, and the letter of a kind even where it only begins a name.
_KEY = "concat_ws(' ', 'тюмень', CASE sw WHEN 'гагарина' THEN 'агарина' ELSE sw END, hb, CASE hm WHEN 'к2' THEN '2' END)"
_KEYS = [f"{v}k AS (SELECT *, {_KEY} AS key FROM {v})" for v in ("addr_a", "addr_b")]
_BOTH = f"WITH addr_a AS ({_duck('addr_a')}), addr_b AS ({_duck('addr_b')}), {', '.join(_KEYS)} "


@query(
    _BOTH
    + """, n AS (SELECT key, count(*) AS n FROM addr_bk WHERE key <> '' GROUP BY key)
SELECT CASE WHEN b.key IS NULL THEN 'только A' WHEN a.key IS NULL THEN 'только B' WHEN n.n = 1 THEN 'сопоставлено'
       ELSE concat('сопоставлено: ', n.n, ' строк B') END AS status, a.key AS key_a, b.key AS key_b, a.row_idx AS a_row, b.row_idx AS b_row
FROM (SELECT * FROM addr_ak WHERE key <> '') a FULL JOIN (SELECT * FROM addr_bk WHERE key <> '') b ON a.key = b.key LEFT JOIN n ON b.key = n.key"""
)
def compare_tables_status(spark, sf_dir):
    # keys are worked out in many tasks and read as a table: as expressions they would be asked for again by the filters
    return compare.compare_tables(*(settled(keyed(spark, sf_dir, v, True).select("row_idx", "key"), "keyed") for v in ("addr_a", "addr_b")))


@query(
    _BOTH
    + """, m AS (SELECT key, count(*) AS n, (SELECT 1) AS one FROM addr_bk WHERE key <> '' GROUP BY key),
d AS (SELECT key, payload, min(row_idx) AS first FROM addr_bk WHERE key <> '' GROUP BY key, payload),
p AS (SELECT key, string_agg(payload, chr(10) ORDER BY first) AS payload FROM d GROUP BY key)
SELECT a.row_idx, a.address, a.payload, a.key, p.payload AS src_payload,
       CASE WHEN m.n IS NULL THEN 'не найдено' WHEN m.n = 1 THEN 'сопоставлено' ELSE concat('сопоставлено: ', m.n, ' записи') END AS status
FROM addr_ak a LEFT JOIN m ON a.key = m.key LEFT JOIN p ON a.key = p.key WHERE a.key <> ''"""
)
def move_columns_merge_distinct(spark, sf_dir):
    return compare.move_columns(keyed(spark, sf_dir, "addr_a").select("row_idx", "address", "payload", "key"), keyed(spark, sf_dir, "addr_b"), ["payload"])


@query(
    _BOTH
    + """SELECT 'multiple_source_rows' AS reason, a.key, a.row_idx AS row, s.raw FROM addr_ak a
JOIN (SELECT key, string_agg(address, ' | ' ORDER BY row_idx) AS raw FROM addr_bk GROUP BY key HAVING count(*) > 1) s ON a.key = s.key
UNION ALL SELECT 'source_not_found_in_primary', key, row_idx, address FROM addr_bk WHERE key NOT IN (SELECT key FROM addr_ak)"""
)
def move_columns_audit(spark, sf_dir):
    return compare.move_audit(keyed(spark, sf_dir, "addr_a"), keyed(spark, sf_dir, "addr_b"), "address")


@query(_BOTH + "SELECT min(row_idx) AS row_idx, key FROM addr_bk WHERE key <> '' AND key NOT IN (SELECT key FROM addr_ak) GROUP BY key")
def append_new_cores(spark, sf_dir):
    return compare.append_new(keyed(spark, sf_dir, "addr_b"), keyed(spark, sf_dir, "addr_a")).select("row_idx", "key")


@query(
    _BOTH
    + """, c AS (SELECT key, count(*) AS n FROM addr_bk GROUP BY key), k AS (SELECT key, count(*) AS n FROM addr_ak GROUP BY key),
j AS (SELECT count(*) FILTER (WHERE c.key = k.key) AS matched, count(*) FILTER (WHERE c.key IS NULL) AS missing, count(*) FILTER (WHERE k.key IS NULL) AS extra,
  sum(c.n - 1)::BIGINT AS collected_duplicates, sum(k.n - 1)::BIGINT AS control_duplicates FROM c FULL JOIN k ON c.key = k.key)
SELECT *, round(matched / (matched + missing), 6) AS coverage, round(matched / (matched + extra), 6) AS precision FROM j"""
)
def benchmark_coverage_precision(spark, sf_dir):
    return compare.benchmark(keyed(spark, sf_dir, "addr_b"), keyed(spark, sf_dir, "addr_a"))


def _sides(spark, sf_dir):
    return keyed(spark, sf_dir, "addr_a"), keyed(spark, sf_dir, "addr_b").withColumnRenamed("row_idx", "cand_idx")


_LIFO = """, g AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY row_idx) AS n FROM addr_ak),
c AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY row_idx DESC) AS n FROM addr_bk)
SELECT g.row_idx, c.row_idx AS cand_idx FROM g JOIN c ON g.n = c.n AND {on}"""


@query(_BOTH + _LIFO.format(k="key", on="g.key = c.key"))
def match_exact_lifo(spark, sf_dir):
    return matching.pair_occurrences(*_sides(spark, sf_dir), ["key"])


@query(_BOTH + _LIFO.format(k="sw, hb, hm", on="g.sw = c.sw AND g.hb = c.hb AND g.hm = c.hm"))
def match_component_lifo(spark, sf_dir):
    return matching.pair_occurrences(*_sides(spark, sf_dir), ["sw", "hb", "hm"])


def _cascade(spark, sf_dir, passes=("text", "key", "key_without_modifiers", "street_house")):
    gt, cand = _sides(spark, sf_dir)
    extra = {"text": F.col("key"), "ter": F.lit(""), "sn": F.array().cast("array<string>")}
    gt, cand = (settled(x.withColumns(extra).drop("address", "payload")) for x in (gt, cand))
    return gt, cand, matching.cascade(gt, cand, passes)


_PASSES = """, g1 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY row_idx) AS n FROM addr_ak),
c1 AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY row_idx DESC) AS n FROM addr_bk),
p1 AS (SELECT g1.row_idx, c1.row_idx AS cand_idx FROM g1 JOIN c1 USING (key, n)),
g2 AS (SELECT *, row_number() OVER (PARTITION BY sw, hb, hm ORDER BY row_idx) AS n FROM addr_ak WHERE row_idx NOT IN (SELECT row_idx FROM p1)),
c2 AS (SELECT *, row_number() OVER (PARTITION BY sw, hb, hm ORDER BY row_idx DESC) AS n FROM addr_bk WHERE row_idx NOT IN (SELECT cand_idx FROM p1)),
p2 AS (SELECT g2.row_idx, c2.row_idx AS cand_idx FROM g2 JOIN c2 USING (sw, hb, hm, n))
"""


@query(_BOTH + _PASSES + "SELECT * FROM (SELECT 'text' AS pass, count(*) AS matches FROM p1 UNION ALL SELECT 'key', count(*) FROM p2) WHERE matches > 0")
def match_cascade_counts(spark, sf_dir):
    return matching.pass_counts(_cascade(spark, sf_dir)[2])


@query(
    _BOTH
    + _PASSES
    + """SELECT row_idx AS cand_idx, sw, hb, hm, EXISTS (SELECT 1 FROM addr_ak a WHERE a.sw = b.sw AND a.hb = b.hb AND a.hm = b.hm) AS known
FROM addr_bk b WHERE row_idx NOT IN (SELECT cand_idx FROM p1 UNION ALL SELECT cand_idx FROM p2)"""
)
def unmatched_tail(spark, sf_dir):
    gt, cand, pairs = _cascade(spark, sf_dir)
    return matching.unmatched_tail(cand.select("cand_idx", "sw", "hb", "hm"), gt, pairs, ["sw", "hb", "hm"])


@query(_BOTH + _LIFO.format(k="key", on="g.key = c.key").replace("c.row_idx AS cand_idx", "c.row_idx AS cand_idx, c.payload"))
def match_with_companions(spark, sf_dir):
    gt, cand = _sides(spark, sf_dir)
    return matching.with_companions(matching.pair_occurrences(gt, cand, ["key"]), cand, ["payload"])


@query()
def match_fuzzy_greedy(spark, sf_dir):
    """Similar streets at one house, greedily. Rounds, so no SQL; held against a plain walk in the tests."""
    extra = {"ter": F.lit(""), "sn": F.array().cast("array<string>")}
    gt, cand = (x.withColumns(extra) for x in _sides(spark, sf_dir))
    return matching.greedy_assignment(*matching.scored_lists(gt, cand, False, matching.RELAXED, True))


@query(
    _BOTH
    + """, g AS (SELECT row_idx, sw, hb, hm, row_number() OVER (PARTITION BY sw, hb, hm ORDER BY row_idx) AS k FROM addr_a),
c AS (SELECT row_idx AS cand_idx, sw, hb, hm, row_idx % 3 = 0 AS short, row_number() OVER (PARTITION BY sw, hb, hm ORDER BY row_idx % 3 = 0, row_idx) AS k FROM addr_b)
SELECT row_idx, cand_idx, round(CASE WHEN short THEN 200.0::DOUBLE * (length(g.sw) - 1) / (2 * length(g.sw) - 1) ELSE 100.0 END + 50.0 + CASE WHEN hm <> '' THEN 20.0 ELSE 0.0 END, 6)::DOUBLE AS weight
FROM g JOIN c USING (sw, hb, hm, k)"""
)
def match_misspelled_streets(spark, sf_dir):
    """A third of the candidates lack their street's last letter: rows take the right ones first, then these. No other two streets are as similar."""
    extra = {"ter": F.lit(""), "sn": F.array().cast("array<string>")}
    gt, cand = (x.withColumns(extra) for x in _sides(spark, sf_dir))
    cand = cand.withColumn("sw", F.when(F.col("cand_idx") % 3 == 0, F.left("sw", F.length("sw") - 1)).otherwise(F.col("sw")))
    found = assign(*matching.scored_links(gt, cand, False, matching.RELAXED, True))
    return found.select("row_idx", "cand_idx", F.round("weight", 6).alias("weight"))


@query(_BOTH + "SELECT row_idx, '' AS ter, sw, '' AS sn, hb, hm FROM addr_a UNION ALL SELECT -1 - row_idx, '', sw, '', hb, hm FROM addr_b")
def parse_addresses(spark, sf_dir):
    both = view(spark, sf_dir, "addr_a").select("row_idx", "address").unionByName(view(spark, sf_dir, "addr_b").select((-1 - F.col("row_idx")).alias("row_idx"), "address"))
    p = A.parsed(both, "address", city="тюмень")
    return p.select("row_idx", "parsed.ter", "parsed.sw", F.array_join("parsed.sn", " ").alias("sn"), "parsed.hb", "parsed.hm")


@query(
    _with(
        """SELECT row_idx, trim(regexp_replace(translate(lower(address), 'ё', 'е'), '[^0-9a-zа-я]+', ' ', 'g')) AS normalized,
  list_aggregate(list_sort(list_distinct(string_split(trim(regexp_replace(translate(lower(address), 'ё', 'е'), '[^0-9a-zа-я]+', ' ', 'g')), ' '))), 'string_agg', ' ') AS words FROM addr_a""",
        "addr_a",
    )
)
def normalized_texts(spark, sf_dir):
    a = view(spark, sf_dir, "addr_a").select("row_idx", T.normalized("address").alias("normalized"))
    return a.withColumn("words", F.array_join(F.array_sort(F.array_distinct(F.split("normalized", " "))), " "))


@query(
    _with(
        """SELECT code, max_by(context, length(context)) AS context FROM (
  SELECT DISTINCT c.code, k.code AS context FROM codes c JOIN known k ON starts_with(c.code, k.code)) GROUP BY code""",
        "codes",
        "known",
    )
)
def registry_prefix_context(spark, sf_dir):
    return registry.longest_prefix(view(spark, sf_dir, "codes"), view(spark, sf_dir, "known"))


@query(
    _with(
        """SELECT row_idx, code, scope FROM codes JOIN scopes ON substring(code, 1, 2) = ter
WHERE substring(code, 3, 3)::INT BETWEEN lo AND hi AND NOT substring(code, 3, 3)::INT BETWEEN no_lo AND no_hi""",
        "codes",
        "scopes",
    )
)
def scope_interval_join(spark, sf_dir):
    codes = view(spark, sf_dir, "codes")
    ranges = view(spark, sf_dir, "scopes").select("scope", "ter", F.array(F.struct("lo", "hi")).alias("include"), F.array(F.struct(F.col("no_lo").alias("lo"), F.col("no_hi").alias("hi"))).alias("exclude"))
    return codes.join(registry.scopes_of_codes(codes.select("code").distinct(), ranges), "code").select("row_idx", "code", "scope")


@query(
    """WITH names AS (SELECT DISTINCT concat(p_name, ' ', lower(p_type)) AS name FROM part), keys AS (SELECT DISTINCT p_name AS key FROM part),
s AS (SELECT name, key, 100.0 * len(list_intersect(string_split(name, ' '), string_split(key, ' '))) / len(list_distinct(list_concat(string_split(name, ' '), string_split(key, ' ')))) AS score FROM names, keys)
SELECT name, key, score::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, length(key), key DESC) AS n FROM s WHERE score >= 60) WHERE n = 1"""
)
def registry_jaccard_lookup(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    names = parts.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("name"))
    return registry.lookup_names(names, parts.select(F.col("p_name").alias("key")), 60.0)


@query(
    """WITH terms AS (SELECT DISTINCT trim(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g')) AS term FROM benchmark),
texts AS (SELECT doc_id AS id, trim(regexp_replace(lower(text), '[^0-9a-z]+', ' ', 'g')) AS text FROM documents)
SELECT id, term FROM texts, terms WHERE term <> '' AND contains(concat(' ', text, ' '), concat(' ', term, ' '))"""
)
def term_containment_join(spark, sf_dir):
    """Whole passages that documents hold."""
    plain = lambda c: F.btrim(F.regexp_replace(F.lower(c), "[^0-9a-z]+", " "))
    terms = table(spark, sf_dir, "benchmark").select(plain("text").alias("term")).where("term <> ''").distinct()
    return registry.term_hits(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), plain("text").alias("text")), terms)


@query(
    """WITH f AS (SELECT o_custkey, min_by(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus <> 'F') AS priority, min_by(o_orderstatus, o_orderkey) AS o_orderstatus, count(*) AS source_count FROM orders GROUP BY o_custkey),
e AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY ALL),
x AS (SELECT o_custkey, string_agg(o_orderpriority, ' | ' ORDER BY first) AS examples FROM e GROUP BY o_custkey)
SELECT o_custkey, priority, o_orderstatus, source_count, examples FROM f JOIN x USING (o_custkey)"""
)
def reference_merge_first_nonnull(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("priority", F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")))
    return reference.merge_rows(o, "o_custkey", "o_orderkey", ["priority", "o_orderstatus"], "o_orderpriority")


@query(
    """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey = min(o_orderkey) OVER w THEN 'ready' ELSE 'duplicate' END AS status, count(*) OVER w AS group_size
FROM orders WINDOW w AS (PARTITION BY o_custkey)"""
)
def reference_staging_status(spark, sf_dir):
    return reference.staged(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey").select("o_orderkey", "o_custkey", "status", "group_size")


@query(
    """WITH long AS (SELECT l_partkey, 'flag' AS slot, l_returnflag AS value, l_quantity AS score FROM lineitem UNION ALL SELECT l_partkey, 'status', l_linestatus, l_quantity FROM lineitem),
v AS (SELECT l_partkey, slot, lower(value) AS vote, count(*) AS votes, max(score) AS score, max(value) AS value FROM long GROUP BY ALL)
SELECT l_partkey, slot, value, votes FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, slot ORDER BY votes DESC, score DESC, value DESC) AS n FROM v) WHERE n = 1"""
)
def slot_vote(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_quantity")
    return collect.slot_votes(rows, "l_partkey", ["flag", "status"], "l_quantity")


@query(
    """WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS k, coalesce(lead(n) OVER w, 0) AS second, sum(n) OVER (PARTITION BY o_custkey) AS total, count(*) OVER (PARTITION BY o_custkey) AS kinds FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY n DESC, o_orderstatus))
SELECT o_custkey, o_orderstatus, n FROM r WHERE k = 1 AND (kinds = 1 OR (n >= greatest(2, second * 2) AND n / total >= 0.45))"""
)
def dominant_context(spark, sf_dir):
    return collect.dominant_values(table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus"), ["o_custkey"], "o_orderstatus")


_SLOTS = ("address", "payload", "street", "house")


@query(
    _with(
        "SELECT slot, string_agg(value, ' | ' ORDER BY first) AS samples FROM (SELECT slot, value, first, row_number() OVER (PARTITION BY slot ORDER BY first) AS r FROM ("
        + " UNION ALL ".join(f"SELECT '{s}' AS slot, trim({s}, ' ,') AS value, min(row_idx) AS first FROM addr_blank WHERE trim({s}, ' ,') <> '' GROUP BY 1, 2" for s in _SLOTS)
        + ")) WHERE r <= 5 GROUP BY slot",
        "addr_blank",
    )
)
def slot_fill_samples(spark, sf_dir):
    return reference.fill_samples(view(spark, sf_dir, "addr_blank"), list(_SLOTS), "row_idx")


@query(_with(" UNION ALL ".join(f"SELECT '{s}' AS slot, count(*) FILTER (WHERE trim({s}) <> '') AS filled, round(count(*) FILTER (WHERE trim({s}) <> '') / count(*), 4) AS fill_rate FROM addr_blank" for s in _SLOTS), "addr_blank"))
def slot_fill_summary(spark, sf_dir):
    return reference.fill_summary(view(spark, sf_dir, "addr_blank"), list(_SLOTS))


@query(_with("SELECT count(*) FILTER (WHERE n = 4) AS complete, count(*) FILTER (WHERE n BETWEEN 1 AND 3) AS incomplete, count(*) FILTER (WHERE n = 0) AS empty FROM (SELECT " + " + ".join(f"coalesce(trim({s}) <> '', false)::INT" for s in _SLOTS) + " AS n FROM addr_blank)", "addr_blank"))
def slot_completeness(spark, sf_dir):
    return reference.completeness(view(spark, sf_dir, "addr_blank"), list(_SLOTS))


@query(
    _with(
        """, x AS (SELECT CASE WHEN coalesce(trim(address), '') = '' THEN ['empty_address'] ELSE list_filter([
  CASE WHEN length(address) > 700 THEN 'address_too_long' END,
  CASE WHEN coalesce(street, '') <> '' AND coalesce(house, '') = '' THEN 'street_without_house' END,
  CASE WHEN coalesce(street, '') = '' AND coalesce(house, '') = '' THEN 'no_house' END,
  CASE WHEN regexp_matches(house, '^0+[^0-9]*$') THEN 'invalid_house_number' END,
  CASE WHEN coalesce(street, '') = '' AND coalesce(house, '') <> '' THEN 'house_without_street_or_territory' END], lambda c: c IS NOT NULL) END AS issues FROM addr_blank)
SELECT issue, count(*) AS n_rows FROM (SELECT unnest(CASE WHEN len(issues) = 0 THEN ['clean'] ELSE issues END) AS issue FROM x) GROUP BY issue""",
        "addr_blank",
    ).replace(") , x AS", "), x AS")
)
def issue_codes_summary(spark, sf_dir):
    rows = spread(view(spark, sf_dir, "addr_blank"), "row_idx").withColumn("issues", sanitize.issue_codes({k: F.col(k) for k in ("address", "street", "house")}))
    return reference.issue_summary(rows)


@query(_with("SELECT address, dense_rank() OVER (ORDER BY sw, hb::INT, hm) AS natural_rank FROM (SELECT DISTINCT address, sw, hb, hm FROM addr_b)", "addr_b"))
def natural_sort(spark, sf_dir):
    """Rank of each different address by natural order of street, house and modifiers."""
    a = view(spark, sf_dir, "addr_b").select("address", "sw", "hb", "hm").distinct()
    key = F.concat(T.natural_key("sw"), T.natural_key("hb"), F.when(F.col("hm") == "", F.array(F.lit("0"))).otherwise(F.array(F.lit("1"), F.col("hm"))))
    # ranks over all different addresses: the number of addresses with a smaller key, by counts of keys
    keys = a.select(key.alias("k")).distinct()
    ranked = C.numbered(keys, "k").withColumnRenamed("number", "natural_rank")
    return a.withColumn("k", key).join(ranked, "k").select("address", "natural_rank")


@query(
    """WITH m AS (SELECT conv_id, turn, role, list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM conversations)
SELECT conv_id, turn, carried, coalesce(list_aggregate(list_transform(list_slice(list_sort(list_transform(list_distinct(before), lambda r: {'p': len(before) - list_position(list_reverse(before), r), 'r': r})), -3, -1), lambda x: x.r), 'string_agg', ' > '), '') AS context FROM m"""
)
def context_carry_forward(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    carried = collect.carry_last(lines, F.when(F.col("role") == "user", F.col("turn")), ["conv_id"], "turn")
    return collect.carry_context(carried, F.lit(True), "role", ["conv_id"], "turn").select("conv_id", "turn", "carried", "context")


@query("SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE concat(p_name, '_', n) END AS numbered FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n FROM part)")
def numbered_repeat_names(spark, sf_dir):
    return collect.numbered_names(table(spark, sf_dir, "part"), ["p_brand"], "p_name", "p_partkey").select("p_partkey", "numbered")


@query("SELECT doc_id, unnest(list_slice(f, -8, -1)) AS fragment FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+ [A-Za-z]+') AS f FROM documents)")
def fragment_explode(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(collect.fragments(F.col("text"), "[0-9]+ [A-Za-z]+")).alias("fragment"))


@query("SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE props IS NOT NULL")
def kv_payload_map(spark, sf_dir):
    """Payload maps of events by key: value lines."""
    block = F.regexp_replace(F.regexp_replace("props", '[{}"]', ""), ", *", "\n")
    return table(spark, sf_dir, "events").where("props is not null").select("event_id", F.explode(collect.key_values(block)).alias("key", "value"))


_PROFILED = ("c_name", "c_mktsegment", "c_acctbal")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(avg((trim({c}::VARCHAR) <> '')::INT), 4) AS filled, round(avg(regexp_matches({c}::VARCHAR, '[0-9]')::INT), 4) AS with_digits, round(avg(regexp_matches({c}::VARCHAR, '[a-zA-Zа-яА-Я]')::INT), 4) AS with_letters, 0.0::DOUBLE AS with_hint, round(avg(length({c}::VARCHAR)), 4) AS mean_length FROM customer"
        for c in _PROFILED
    )
)
def content_profile(spark, sf_dir):
    return profile.content_profile(table(spark, sf_dir, "customer"), list(_PROFILED))


@query(_with("SELECT row_idx, address, payload FROM addr_blank WHERE coalesce(trim(address), '') <> '' OR coalesce(trim(payload), '') <> ''", "addr_blank"))
def empty_row_filter(spark, sf_dir):
    return profile.without_blank_rows(view(spark, sf_dir, "addr_blank").select("row_idx", "address", "payload"), ["address", "payload"])


@query(_with(" UNION ALL ".join(f"SELECT row_idx, {i} AS col_idx, trim({c}) AS value FROM addr_blank WHERE trim({c}) <> ''" for i, c in enumerate(("address", "payload", "street"))), "addr_blank"))
def sheet_cells(spark, sf_dir):
    return C.cells_of(view(spark, sf_dir, "addr_blank"), ["address", "payload", "street"]).select("row_idx", "col_idx", "value")


@query(_with("SELECT row_idx FROM addr_blank WHERE length(trim(coalesce(address, ''))) BETWEEN 6 AND 2500", "addr_blank"))
def plausible_addresses(spark, sf_dir):
    return view(spark, sf_dir, "addr_blank").where(collect.plausible(F.col("address"))).select("row_idx")


@query(
    _with(
        """SELECT coalesce(reason, 'kept') AS reason, count(*) AS n_rows FROM (SELECT CASE WHEN coalesce(address, '') = '' THEN 'empty_address'
  WHEN coalesce(house, '') = '' AND coalesce(street, '') <> '' THEN 'street_without_house' WHEN coalesce(house, '') = '' THEN 'no_house'
  WHEN coalesce(street, '') = '' THEN 'house_without_street_or_territory' END AS reason FROM addr_blank) GROUP BY ALL""",
        "addr_blank",
    )
)
def sanitizer_reasons(spark, sf_dir):
    rows = spread(view(spark, sf_dir, "addr_blank"), "row_idx").withColumn("house", F.concat(F.lit("д. "), "house"))
    reason = sanitize.drop_reason({k: F.col(k) for k in ("address", "street", "house")})
    return rows.select(F.coalesce(reason, F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n_rows"))


@query(_BOTH + "SELECT 'both' AS side, count(*) AS n_keys FROM (SELECT key FROM addr_ak INTERSECT SELECT key FROM addr_bk) UNION ALL SELECT 'only_a', count(*) FROM (SELECT key FROM addr_ak EXCEPT SELECT key FROM addr_bk) UNION ALL SELECT 'only_b', count(*) FROM (SELECT key FROM addr_bk EXCEPT SELECT key FROM addr_ak)")
def key_sets(spark, sf_dir):
    return compare.key_sets(*(keyed(spark, sf_dir, v) for v in ("addr_a", "addr_b")))


@query()
def final_output_dedupe(spark, sf_dir):
    """Orders by two keys, each of which an earlier kept order may hold. A fixpoint, so no SQL; held against a plain loop in the tests."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("|", "o_custkey", "o_orderstatus").alias("core"), F.concat_ws("|", F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority").alias("text"))
    return collect.dedupe_by_any_key(o, "o_orderkey", ["core", "text"])


@query("SELECT conv_id, turn, n, line FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM conversations) WHERE trim(line) <> ''")
def text_line_candidates(spark, sf_dir):
    return C.lines_of(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text").select("conv_id", "turn", "n", "line")


@query("SELECT c_nationkey AS scope, count(*) AS n_rows FROM customer GROUP BY c_nationkey")
def registry_statistics_by_scope(spark, sf_dir):
    """Rows of the registry by subject: every code of a nation is in its scope."""
    codes = view(spark, sf_dir, "codes")
    scopes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("scope"), F.substring(F.concat(F.lit("00"), F.col("n_nationkey").cast("string")), -2, 2).alias("ter"), *[F.array().cast("array<struct<lo:int,hi:int>>").alias(c) for c in ("include", "exclude")])
    return registry.subject_scopes(codes, scopes)


_LINE = "concat('г. Тюмень, ул. ', {street}, ', д. ', {house}, CASE {k} % 7 WHEN 0 THEN ', к. 2' ELSE '' END)"


@query(
    "SELECT c_custkey AS row_idx, " + _LINE.format(street=_street("c_custkey"), house="1 + c_custkey % 40", k="c_custkey") + " AS line FROM customer UNION ALL SELECT -1 - s_suppkey, " + _LINE.format(street=_street("s_suppkey"), house="1 + s_suppkey % 53", k="s_suppkey") + " FROM supplier"
)
def address_lines(spark, sf_dir):
    """Both sides' addresses as cards, written out the same way."""
    both = view(spark, sf_dir, "addr_a").select("row_idx", "address").unionByName(view(spark, sf_dir, "addr_b").select((-1 - F.col("row_idx")).alias("row_idx"), "address"))
    return S.with_slots(both, "address", "тюмень").select("row_idx", S.line_of(F.col("slots")).alias("line"))


@query(_with("SELECT row_idx, 'г. Тюмень' AS locality, concat('ул. ', upper(substring(sw, 1, 1)), substring(sw, 2)) AS street, hb AS house_base, nullif(hm, '') AS house_mods, concat(sw, '||', hb, '|', hm) AS match_key FROM addr_a", "addr_a"))
def reference_slots(spark, sf_dir):
    n = S.normalized_addresses(view(spark, sf_dir, "addr_a").select("row_idx", "address"), "address", None, "тюмень")
    return n.select("row_idx", "slots.locality", "slots.street", "slots.house_base", "slots.house_mods", "match_key")


@query("SELECT o_custkey, o_orderkey, coalesce(priority, d) AS priority FROM (SELECT *, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS priority FROM orders) o LEFT JOIN (SELECT o_custkey AS c, o_orderpriority AS d FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL) WINDOW w AS (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) QUALIFY (count(*) OVER (PARTITION BY o_custkey) = 1 OR (n >= greatest(2, 2 * coalesce(lead(n) OVER w, 0)) AND n / sum(n) OVER (PARTITION BY o_custkey) >= 0.45)) AND row_number() OVER w = 1) x ON o.o_custkey = x.c")
def fill_from_dominant(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("priority"))
    return collect.filled_from(o, collect.dominant_values(o, ["o_custkey"], "priority"), ["o_custkey"], "priority").select("o_custkey", "o_orderkey", "priority")


@query("SELECT min(p_partkey) AS p_partkey, p_name, p_brand FROM part GROUP BY p_name, p_brand")
def first_seen_candidates(spark, sf_dir):
    return collect.dedupe_candidates(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "p_name", ["p_brand"], "p_partkey")


@query(_with(", c AS (SELECT DISTINCT code, substring(code, 1, 5) AS d, substring(code, 1, 8) AS h FROM codes) SELECT code, (SELECT count(*) FROM c x WHERE x.d = c.d) - (SELECT count(*) FROM c x WHERE x.d = c.d AND x.h = c.h) AS n_conflicts FROM c", "codes").replace(") , c AS", "), c AS"))
def conflicting_codes(spark, sf_dir):
    """How many codes of its district each code contradicts: those with other first eight digits."""
    c = view(spark, sf_dir, "codes").select("code", F.substring("code", 1, 5).alias("district")).distinct()
    return collect.code_conflicts(c, "district").select("code", "n_conflicts")


@query("SELECT role, contains(text, chr(10)) AS valid, count(*) AS n FROM conversations GROUP BY ALL")
def candidate_kind_summary(spark, sf_dir):
    """Turns by role and by whether they have several lines."""
    return collect.scope_summary(table(spark, sf_dir, "conversations").select("role", F.col("text").contains("\n").alias("valid")))
