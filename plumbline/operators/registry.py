"""The territory registry: codes, contexts, name lookup, scopes and search keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import level_key, normalized, region_key, registry_key, word_jaccard
from plumbline.operators.similar import similar_texts

#: Weights of scope keys by what they name, and the least similarity of a name.
MUNICIPALITY_WEIGHT, LOCALITY_WEIGHT, FREQUENT_WEIGHT, MANUAL_WEIGHT = 45.0, 90.0, 20.0, 35.0
NAME_CUTOFF, REGION_CUTOFF, SETTLEMENT_CUTOFF = 72.0, 76.0, 86.0


def with_codes(rows: DataFrame) -> DataFrame:
    """Registry rows of sections 1 and 2 with their padded code."""
    parts = [F.lpad(F.btrim(c), n, "0") for c, n in (("ter", 2), ("kod1", 3), ("kod2", 3), ("kod3", 3))]
    return rows.where(F.col("section").isin("1", "2")).withColumn("code", F.regexp_replace(F.concat(*parts), "(?:000)+$", ""))


def longest_prefix(codes: DataFrame, registry: DataFrame, code: str = "code", least: int = 2) -> DataFrame:
    """code, context: the registry code that is equal, or the longest that begins it.

    Each code is unfolded into its prefixes, so this is an equi-join, not a comparison of all pairs.
    """
    prefixes = codes.select(code).distinct().select(code, F.explode(F.sequence(F.length(code), F.lit(least), F.lit(-1))).alias("n")).where(F.col("n") >= least).select(code, F.substring(F.col(code), F.lit(1), F.col("n")).alias("context"))
    return prefixes.join(registry.select(F.col("code").alias("context")).distinct(), "context").groupBy(code).agg(F.max_by("context", F.length("context")).alias("context"))


def in_ranges(number: Column, ranges: Column) -> Column:
    return F.exists(ranges, lambda r: number.between(r["lo"], r["hi"]))


def scopes_of_codes(codes: DataFrame, scopes: DataFrame) -> DataFrame:
    """code, scope. scopes: scope, ter, include, exclude (arrays of lo, hi). Joined on ter, then tested by range."""
    c = codes.select("code", F.substring("code", 1, 2).alias("ter"), F.substring("code", 3, 3).cast("int").alias("kod1"))
    inside = (F.size("include") == 0) | in_ranges(F.col("kod1"), F.col("include"))
    return c.join(scopes, "ter").where(inside & ~in_ranges(F.col("kod1"), F.col("exclude"))).select("code", "scope")


def values_of_codes(codes: DataFrame, rules: DataFrame) -> DataFrame:
    """code, value: what the first rule that fits says of a code, or null.

    rules: ter, lo, hi (a range of the three digits behind ter), block (ter and three digits), prefix
    (of the code), value, n (their order); each row is of one kind, its other fields null. Ranges go
    before blocks, blocks before prefixes; of ranges and blocks the first, of prefixes the longest.
    A range is unfolded into the blocks it covers (at most 1,000) and a code into its head and its
    prefixes, so all three are one equi-join.
    """
    digits = F.regexp_replace("code", "[^0-9]+", "")
    three = lambda c: F.lpad(c.cast("string"), 3, "0")
    inside = F.transform(F.sequence(F.greatest(F.lit(0), F.col("lo")), F.least(F.lit(999), F.col("hi"))), lambda k: F.concat("ter", three(k)))
    r = rules.select(F.when(F.col("lo").isNotNull(), 0).when(F.col("block").isNotNull(), 1).otherwise(2).alias("kind"), F.when(F.col("lo") > F.col("hi"), F.array().cast("array<string>")).when(F.col("lo").isNotNull(), inside).otherwise(F.array(F.coalesce("block", "prefix"))).alias("keys"), "value", "n")
    r = r.select("kind", F.explode("keys").alias("_k"), "value", "n")
    c = codes.select("code").distinct().withColumn("_d", digits)
    head = F.when(F.length("_d") >= 5, F.array(F.struct(F.lit(0).alias("kind"), F.substring("_d", 1, 5).alias("k")), F.struct(F.lit(1).alias("kind"), F.substring("_d", 1, 5).alias("k")))).otherwise(F.array().cast("array<struct<kind:int,k:string>>"))
    prefixes = F.when(F.length("_d") > 0, F.transform(F.sequence(F.lit(1), F.length("_d")), lambda i: F.struct(F.lit(2).alias("kind"), F.substring(F.col("_d"), F.lit(1), i).alias("k")))).otherwise(F.array().cast("array<struct<kind:int,k:string>>"))
    asked = c.select("code", F.explode(F.concat(head, prefixes)).alias("e")).select("code", F.col("e.kind").alias("kind"), F.col("e.k").alias("_k"))
    best = asked.join(r, ["kind", "_k"]).groupBy("code").agg(F.min(F.struct("kind", F.negative(F.length("_k")).alias("l"), "n", "value")).alias("b"))
    return codes.select("code").distinct().join(best, "code", "left").select("code", F.col("b.value").alias("value"))


def subject_scope_of_codes(codes: DataFrame, ranges: DataFrame, parents: DataFrame) -> DataFrame:
    """code, scope: the scope whose range holds a code, else the one of its parent subject in its territory, else the territory.

    codes: code, parent (a subject's name, may be null); ranges: ter, lo, hi, value, n; parents: ter,
    stem (of the parent's normalized name), value.
    """
    rules = ranges.select("ter", "lo", "hi", F.lit(None).cast("string").alias("block"), F.lit(None).cast("string").alias("prefix"), "value", "n")
    first = values_of_codes(codes, rules)
    ter = F.substring(F.regexp_replace("code", "[^0-9]+", ""), 1, 2)
    c = codes.withColumns({"_t": ter, "_p": region_key("parent")})
    # a territory has a few rules for parents, so this join adds a few rows to a code at most
    by_parent = c.join(parents.select(F.col("ter").alias("_t"), "stem", F.col("value").alias("_v")), "_t").where(F.col("_p").contains(F.col("stem"))).groupBy("code").agg(F.min("_v").alias("_v"))
    return c.select("code", "_t").distinct().join(first, "code").join(by_parent, "code", "left").select("code", F.coalesce("value", "_v", "_t").alias("scope"))


#: What a parent territory's name holds; a place of its own goes before it.
PARENT_WORDS = "муниципальн|городской округ|район|сельское поселение|городское поселение|сельсовет|поссовет"
#: Words that a comparison of municipalities leaves out, in all their forms.
MUNICIPALITY_STEMS = "муниципальн\\w*|городск\\w*|округ\\w*|район\\w*|сельск\\w*|поселени[ея]|сельсовет|поссовет"


def municipality_key(name: Column | str) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(normalized(name), f"(?iuU)(?<![0-9a-zа-я])(?:{MUNICIPALITY_STEMS})(?![0-9a-zа-я])", " "), " +", " "))


def lookup_scoped(asked: DataFrame, index: DataFrame, cutoff: float = NAME_CUTOFF) -> DataFrame:
    """name, scope, hint, code, found, municipality, score: the registry row that fits each name in its scope.

    asked: name, scope (null: all), hint (a municipality, may be null); index: scope, code, name,
    municipality (null if none). First the key most similar to the name among the scope's keys (equal
    keys meet at once, the shortest of equals), then among its rows those of the hinted municipality,
    if it has any, then a place before a parent territory, then the longest code, then the first.
    Keys meet by (scope, rare word), so equal names in two scopes don't.
    """
    idx = index.select("scope", "code", F.col("name").alias("found"), "municipality", registry_key("name").alias("b")).where("b <> ''")
    everywhere = idx.withColumn("scope", F.lit(""))
    idx = idx.where("scope is not null").unionByName(everywhere).distinct() if asked.where("scope is null").limit(1).count() else idx.where("scope is not null")
    q = asked.select("name", "scope", "hint").distinct().withColumns({"_s": F.coalesce("scope", F.lit("")), "a": registry_key("name")}).where("a <> ''")
    keys = idx.select(F.col("scope").alias("_s"), "b").distinct()
    alike = similar_texts(q.select("_s", "a"), keys, cutoff, ("_s",), "jaccard")
    best = alike.groupBy("_s", "a").agg(F.max(F.struct("similarity", (F.col("a") == F.col("b")).alias("_e"), F.negative(F.length("b")).alias("_l"), "b")).alias("k")).select("_s", "a", F.col("k.b").alias("b"), F.col("k.similarity").alias("score"))
    met = q.join(best, ["_s", "a"]).join(idx.withColumnRenamed("scope", "_s"), ["_s", "b"])
    fits = F.coalesce((F.col("hint") != "") & (municipality_key("municipality") == municipality_key("hint")), F.lit(False))
    own = ~normalized("found").rlike(PARENT_WORDS)
    rank = F.struct(fits.alias("_f"), own.alias("_w"), F.length("code").alias("_n"), F.negative(F.conv("code", 10, 10).cast("decimal(38,0)")).alias("_c"))
    return met.groupBy("name", "scope", "hint").agg(F.max_by(F.struct("code", "found", "municipality", "score"), rank).alias("r")).select("name", "scope", "hint", "r.*")


def lookup_municipality(asked: DataFrame, index: DataFrame, cutoff: float = NAME_CUTOFF) -> DataFrame:
    """name, scope, hint, code, municipality: that of the code, if the scope has it, else that of the place found by name.

    asked: name, scope, hint, code (all but one may be null); index as in lookup_scoped().
    """
    known = index.where("municipality is not null").groupBy("scope", F.col("code").alias("_c")).agg(F.min("municipality").alias("_m"))
    ids = ["name", "scope", "hint", "code"]
    digits = F.regexp_replace("code", "[^0-9]+", "")
    q = asked.select(*ids).distinct().withColumn("_d", digits)
    held = (F.col("_d") == F.col("_c")) & (F.col("scope").isNull() | (F.col("scope") == F.col("_s")))
    out = q.join(known.withColumnRenamed("scope", "_s"), held, "left").groupBy(*ids).agg(F.min("_m").alias("_by_code"))
    by_name = lookup_scoped(asked.where("name is not null"), index.where("municipality is not null"), cutoff).select("name", F.col("scope").alias("_s2"), F.col("hint").alias("_h2"), F.col("municipality").alias("_by_name")).withColumnRenamed("name", "_n2")
    return out.join(by_name, F.col("name").eqNullSafe(F.col("_n2")) & F.col("scope").eqNullSafe(F.col("_s2")) & F.col("hint").eqNullSafe(F.col("_h2")), "left").select(*ids, F.coalesce("_by_code", "_by_name").alias("municipality"))


def name_index(registry: DataFrame) -> DataFrame:
    """key, code, name, ter: different, by level key."""
    return registry.select(level_key("name").alias("key"), "code", "name", "ter").where("key <> ''").dropDuplicates(["key", "code"])


def lookup_names(names: DataFrame, index: DataFrame, cutoff: float = NAME_CUTOFF) -> DataFrame:
    """name, key, score: the most similar index key of each name, equal keys first.

    Equal keys join at once. Only the rest is compared, and only with keys that share one of the
    rarest words that the cutoff allows to differ: two sets that reach it share one of the first
    size - ceil(cutoff * size) + 1 words of each, in one order of all words.
    """
    asked = names.select(F.col("name")).distinct().withColumn("asked", level_key("name")).where("asked <> ''")
    keys = index.select("key").distinct()
    exact = asked.join(keys, asked["asked"] == keys["key"]).select("name", "key", F.lit(100.0).alias("score"))
    rest = asked.join(exact.select("name"), "name", "left_anti")
    words = lambda df, c: df.select(c, F.explode(F.array_distinct(F.split(c, " "))).alias("_w"))
    uses = words(keys, "key").groupBy("_w").agg(F.count("*").alias("_n"))

    def rare(df: DataFrame, c: str) -> DataFrame:
        own = words(df.select(c).distinct(), c).join(uses, "_w", "left")
        nth = F.row_number().over(Window.partitionBy(c).orderBy(F.coalesce("_n", F.lit(0)), "_w"))
        size = F.size(F.array_distinct(F.split(c, " ")))
        return own.withColumn("_r", nth).where(F.col("_r") <= size - F.ceil(size * (cutoff / 100.0) - 1e-9) + 1).select(c, "_w")

    met = rare(rest, "asked").join(rare(keys, "key"), "_w").select("asked", "key").distinct().join(rest, "asked")
    scored = met.withColumn("score", word_jaccard(F.col("asked"), F.col("key"))).where(F.col("score") >= cutoff)
    best = scored.groupBy("name").agg(F.max(F.struct("score", F.negative(F.length("key")).alias("_l"), "key")).alias("b")).select("name", F.col("b.key").alias("key"), F.col("b.score").alias("score"))
    return exact.unionByName(best)


def municipalities(codes: DataFrame, registry: DataFrame) -> DataFrame:
    """code, municipality: the name of the row's district."""
    district = registry.where(F.length("code") == 5).select(F.col("code").alias("d"), F.col("name").alias("municipality"))
    return codes.join(district, F.substring("code", 1, 5) == F.col("d"), "left").drop("d")


#: Kinds of subjects; two names with different kinds are never the same subject.
SUBJECT_KINDS = {"область": ("область", "области", "обл"), "край": ("край", "края"), "республика": ("республика", "республики", "респ"), "округ": ("округ", "округа", "ао"), "город": ("город", "города", "г")}


def subject_kinds(name: Column | str) -> Column:
    """The kinds of subject that a name holds."""
    words = F.split(normalized(name), " ")
    return F.array_compact(F.array(*[F.when(F.arrays_overlap(words, F.array(*map(F.lit, forms))), kind) for kind, forms in SUBJECT_KINDS.items()]))


def match_regions(names: DataFrame, regions: DataFrame, cutoff: float = REGION_CUTOFF) -> DataFrame:
    """name, region_id, score: the region of the greatest word similarity that reaches the cutoff, the first of equals.

    regions: region_id, name (a row for each variant). Names whose kinds of subject have nothing in
    common score 0. Only names that share a rare enough word meet.
    """
    a = names.select("name").distinct().withColumns({"a": region_key("name"), "kinds": subject_kinds("name")})
    b = regions.select("region_id", region_key("name").alias("b"), subject_kinds("name").alias("kinds_b")).distinct()
    alike = similar_texts(a.select("a"), b.select("b"), cutoff, similarity="jaccard")
    other = (F.size("kinds") > 0) & (F.size("kinds_b") > 0) & ~F.arrays_overlap("kinds", "kinds_b")
    scored = alike.join(a, "a").join(b, "b").where(~other)
    return scored.groupBy("name").agg(F.max(F.struct(F.col("similarity").alias("score"), F.negative("region_id").alias("n"))).alias("b")).select("name", F.negative("b.n").alias("region_id"), F.col("b.score").alias("score"))


def settlement_search(index: DataFrame, term: str, limit: int = 20, cutoff: float = SETTLEMENT_CUTOFF) -> DataFrame:
    """code, name, score, unambiguous: the best rows for a search term; the limit is the feature."""
    spark = index.sparkSession
    asked = spark.createDataFrame([(term,)], "name string")
    keys = lookup_names(asked, index, cutoff).select("key", "score")
    found = index.join(F.broadcast(keys), "key").groupBy("code", "name", "ter").agg(F.max("score").alias("score"))
    flagged = found.withColumn("unambiguous", F.count("*").over(Window.partitionBy("ter", normalized("name"))) == 1)
    return flagged.orderBy(F.desc("score"), "code").limit(limit)


def scope_keys(registry: DataFrame, municipality_code: str, frequent: int = 3) -> DataFrame:
    """value, role, weight, context_required: search keys of a municipality and its localities."""
    own = registry.where(F.col("code") == municipality_code).select(level_key("name").alias("value"), F.lit("municipality").alias("role"), F.lit(MUNICIPALITY_WEIGHT).alias("weight"), F.lit(False).alias("context_required"))
    uses = registry.groupBy(level_key("name").alias("value")).agg(F.count("*").alias("uses"))
    local = registry.where(F.col("code").startswith(municipality_code) & (F.col("code") != municipality_code)).select(level_key("name").alias("value")).distinct().join(uses, "value")
    often = F.col("uses") >= frequent
    return own.unionByName(local.select("value", F.lit("locality").alias("role"), F.when(often, FREQUENT_WEIGHT).otherwise(LOCALITY_WEIGHT).alias("weight"), often.alias("context_required"))).where("value <> ''")


def with_user_keys(keys: DataFrame, user: DataFrame) -> DataFrame:
    """keys and the user's own values, which count little and need a context."""
    own = user.select(normalized("value").alias("value"), F.lit("manual").alias("role"), F.lit(MANUAL_WEIGHT).alias("weight"), F.lit(True).alias("context_required")).where("value <> ''")
    both = keys.unionByName(own)
    return both.groupBy("value", "role").agg(F.max("weight").alias("weight"), F.bool_and("context_required").alias("context_required"))


def user_keys(texts: DataFrame, text: str, order: str) -> DataFrame:
    """value, key: the keys of lines or of parts between semicolons, the first spelling of each normalized key."""
    parts = texts.select(order, F.posexplode(F.split(F.col(text), "[\n\r;]+")).alias("_i", "value")).select(F.struct(order, "_i").alias("_o"), F.btrim("value").alias("value"), normalized("value").alias("key"))
    return parts.where("key <> ''").groupBy("key").agg(F.min_by("value", "_o").alias("value")).select("value", "key")


def contains_term(text: Column, term: Column) -> Column:
    """Whole-term containment of normalized texts."""
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(F.concat(F.lit(" "), term, F.lit(" ")))


def term_hits(texts: DataFrame, terms: DataFrame, text_id: str = "id") -> DataFrame:
    """id, term: terms that a text holds whole. Joined on the term's rarest word, then tested.

    texts: id, text; terms: term; all normalized.
    """
    words = terms.select("term", F.explode(F.array_distinct(F.split("term", " "))).alias("w"))
    rare = words.join(words.groupBy("w").agg(F.count("*").alias("n")), "w").groupBy("term").agg(F.min_by("w", F.struct("n", "w")).alias("w"))
    # word by word, so that texts are compared only with terms whose word they hold
    held = texts.select(text_id, F.explode(F.array_distinct(F.split("text", " "))).alias("w")).join(rare, "w").select(text_id, "term")
    return held.join(texts, text_id).where(contains_term(F.col("text"), F.col("term"))).select(text_id, "term")


def registry_statistics(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count("*").alias("contexts"), F.count_distinct(level_key("name")).alias("name_keys"), F.count_distinct("ter").alias("subjects"), F.count_if(F.length("code") == 5).alias("municipalities"))


def scope_hits(records: DataFrame, keys: DataFrame, record_id: str = "id") -> DataFrame:
    """id, valid, best, hits: scope keys that a record's text holds whole or whose code it has.

    records: id, text (normalized), code, has_context; keys: value (normalized), role, weight,
    context_required, code. A key that needs a context counts only where there is one or the code
    agrees. The best is the heaviest valid key, the longest of equals.
    """
    by_term = term_hits(records.select(record_id, "text"), keys.select(F.col("value").alias("term")).where("term <> ''").distinct(), record_id)
    k = keys.where("weight > 0 and role <> 'subject'").withColumnRenamed("code", "key_code")
    columns = [record_id, "value", "role", "weight", "context_required", "key_code"]
    met = by_term.join(k, F.col("term") == F.col("value")).select(*columns)
    coded = records.where("code <> ''").select(record_id, F.col("code").alias("_c")).join(k.where("key_code <> ''"), F.col("_c") == F.col("key_code")).select(*columns)
    all_ = met.unionByName(coded).distinct().join(records.select(record_id, F.col("code").alias("record_code"), "has_context"), record_id)
    valid = ~F.col("context_required") | F.col("has_context") | ((F.col("key_code") != "") & (F.col("key_code") == F.col("record_code")))
    hit = F.struct("value", "role", "weight", F.col("key_code").alias("code"), "valid")
    rank = F.struct("valid", "weight", F.length("value").alias("n"), "value")
    return all_.withColumn("valid", F.coalesce(valid, F.lit(False))).groupBy(record_id).agg(F.bool_or("valid").alias("valid"), F.max(rank).getField("value").alias("best"), F.sort_array(F.collect_set(hit)).alias("hits"))


def pair_score(a_hits: Column, b_hits: Column, a_code: Column, b_code: Column) -> Column:
    """Scope bonus of a pair: -80 for codes that don't fit, 14 for codes that do, else the best of its hit pairs, at most 16."""
    from plumbline.operators.matching import BLOCKED, compatible_codes

    both = (a_code != "") & (b_code != "")

    def of(x: Column, y: Column) -> Column:
        low = F.least(x["weight"], y["weight"])
        coded = (x["code"] != "") & (y["code"] != "")
        return F.when(~(x["valid"] & y["valid"]), 0.0).when(coded & ~compatible_codes(x["code"], y["code"]), 0.0).when(coded, low / 6).when(x["value"] == y["value"], low / 10).when((x["role"] == y["role"]) & (x["role"] == "medium"), 4.5).otherwise(0.0)

    best = F.array_max(F.flatten(F.transform(a_hits, lambda x: F.transform(b_hits, lambda y: of(x, y)))))
    return F.when(both & ~compatible_codes(a_code, b_code), BLOCKED).when(both, 14.0).otherwise(F.least(F.lit(16.0), F.coalesce(best, F.lit(0.0))))


def codes_of_municipalities(registry: DataFrame) -> DataFrame:
    """key, name, code: one option for each municipality name, with its longest code, in order of the name."""
    rows = registry.where(F.length("code") <= 8).select(level_key("name").alias("key"), "name", "code").where("key <> ''")
    return rows.groupBy("key").agg(F.max_by(F.struct("name", "code"), F.struct(F.length("code"), F.col("code"))).alias("b")).select("key", "b.*").orderBy("key")


def subject_scopes(registry: DataFrame, scopes: DataFrame) -> DataFrame:
    """scope, n_rows: scopes that have rows in the registry, in order."""
    met = registry.select("code").join(scopes_of_codes(registry.select("code").distinct(), scopes), "code")
    return met.groupBy("scope").agg(F.count("*").alias("n_rows")).orderBy("scope")


def resolve_scope(asked: DataFrame, scopes: DataFrame) -> DataFrame:
    """value, scope: by id, name or code; else the scope whose name the text holds whole, the longest of them.

    scopes: scope (id), name, ter.
    """
    s = scopes.select("scope", normalized("name").alias("n"), "ter").where("n <> ''")
    a = asked.select("value", normalized("value").alias("v")).distinct()
    known = s.select("scope", F.explode(F.array(F.col("n"), F.col("scope").cast("string"), F.col("ter"))).alias("v")).where("v <> ''").groupBy("v").agg(F.min("scope").alias("scope"))
    direct = a.join(known, "v").select("value", "scope")
    rest = a.join(direct, "value", "left_anti").select(F.col("value").alias("id"), F.col("v").alias("text"))
    held = term_hits(rest, s.select(F.col("n").alias("term")).distinct()).join(s, F.col("term") == F.col("n"))
    return direct.unionByName(held.groupBy("id").agg(F.max_by("scope", F.struct(F.length("term"), F.col("term"))).alias("scope")).withColumnRenamed("id", "value"))


#: Words of a municipality of the first kind, and of a settlement's own one.
PRIMARY_WORDS = "муниципальный район|муниципальный округ|городской округ|район"
LOCAL_WORDS = "сельское поселение|городское поселение|сельсовет|поселение"


def row_municipalities(rows: DataFrame, names: DataFrame) -> DataFrame:
    """rows (code, parent_code, district_code) with municipality, municipality_code.

    names: code, section_name, heading_name, one row for each code; a typed name is preferred. The
    parent's name counts, but a settlement gives way to its district.
    """
    primary, local = (lambda c, w=w: F.coalesce(normalized(c).rlike(w), F.lit(False)) for w in (PRIMARY_WORDS, LOCAL_WORDS))
    section, heading = F.col("section_name"), F.col("heading_name")
    typed = F.when(section.isNull(), heading).when(heading.isNull() | primary(section), section).when(local(section) & primary(heading), heading).when(primary(heading) & contains_term(normalized(heading), level_key(section)), heading).otherwise(section)
    n = names.select("code", typed.alias("name")).where("name is not null")
    p, d = (n.select(F.col("code").alias(f"_{x}"), F.col("name").alias(f"_{x}_name")) for x in ("p", "d"))
    both = rows.join(p, F.col("parent_code") == F.col("_p"), "left").join(d, F.col("district_code") == F.col("_d"), "left")
    up = (F.col("parent_code") != F.col("district_code")) & F.col("_p_name").isNotNull() & F.col("_d_name").isNotNull() & local(F.col("_p_name")) & primary(F.col("_d_name"))
    by_district = up | F.col("_p_name").isNull()
    return both.select(*rows.columns, F.when(by_district, F.col("_d_name")).otherwise(F.col("_p_name")).alias("municipality"), F.when(by_district, F.when(F.col("_d_name").isNotNull(), F.col("district_code"))).otherwise(F.col("parent_code")).alias("municipality_code"))


def term_forms(terms: DataFrame, forms: DataFrame | None = None) -> DataFrame:
    """term, form: a search key as it is and with one word in each of its forms; forms: word, form. A word that is not there stays."""
    own = terms.select(F.col("term"), normalized("term").alias("_t")).where("_t <> ''").distinct()
    same = own.select("term", F.col("_t").alias("form"))
    if forms is None:
        return same
    words = own.select("term", "_t", F.posexplode(F.split("_t", " ")).alias("i", "word")).join(forms.select(normalized("word").alias("word"), normalized("form").alias("_f")), "word")
    put = F.array_join(F.transform(F.split("_t", " "), lambda w, k: F.when(k == F.col("i"), F.col("_f")).otherwise(w)), " ")
    return same.unionByName(words.select("term", put.alias("form"))).distinct()


def federal_districts(registry: DataFrame, regions: DataFrame) -> DataFrame:
    """ter, subject, region_id, federal_district: top rows of the registry with their region's district. regions: region_id, name, federal_district."""
    top = registry.where(F.length("code") == 2).select("ter", F.col("name").alias("subject"))
    met = match_regions(top.select(F.col("subject").alias("name")), regions).withColumnRenamed("name", "_s")
    return top.join(met, F.col("subject") == F.col("_s"), "left").join(regions.select("region_id", "federal_district").distinct(), "region_id", "left").select("ter", "subject", "region_id", "federal_district")


def hit_text(hits: Column, most: int = 8) -> Column:
    """`value:role, ...` of the first hits in order of value."""
    return F.array_join(F.slice(F.transform(F.array_sort(hits), lambda h: F.concat(h["value"], F.lit(":"), h["role"])), 1, most), ", ")
