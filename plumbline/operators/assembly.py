"""Assembling collected candidates: the key of a building, votes with what a value is worth, the final dedupe.

Candidates have slots as text columns (street, house, premise, house_mods, municipality, locality,
territory, microdistrict, oktmo_code, ...), which may be null or missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import address as A
from plumbline.functions.slots import renormalized
from plumbline.functions.text import clean, geo_key, normalized
from plumbline.operators import collect, sanitize
from plumbline.sources.scratch import settled

#: Words that are no modifier of a house though a table has them there.
NO_MODIFIERS = ("г", "город", "с", "село", "д", "деревня", "п", "пос", "поселок")
#: What a value adds to its row's score in a vote, by slot.
PLACE_BONUS, INDEX_BONUS, HOUSE_BONUS, STREET_BONUS = 8.0, 8.0, 6.0, 5.0
PLACES = ("subject", "municipality", "locality", "oktmo_code", "oktmo_name", "federal_district")
#: What a value that can't be right takes off.
STREET_PENALTY, HOUSE_PENALTY, PLACE_PENALTY, TERRITORY_PENALTY = 80.0, 60.0, 70.0, 70.0
#: Slots whose votes are compared by what the place is called, without its kind.
GEO_SLOTS = ("municipality", "locality", "territory", "microdistrict", "subject", "parent_subject", "autonomous_okrug")
#: How many examples and sources a merged row keeps, and what stands between them.
EXAMPLES, SOURCES = (5, " | "), (30, "; ")


def column(df: DataFrame, name: str) -> Column:
    return F.coalesce(clean(F.col(name).cast("string")), F.lit("")) if name in df.columns else F.lit("")


def house_kind_key(house: Column) -> Column:
    """д, зд or стр, as the house's text begins; blank for a bare number."""
    t = F.translate(F.lower(F.btrim(F.coalesce(house, F.lit("")))), "ё", "е")
    return F.when(t.startswith("зд"), "зд").when(t.startswith("стр"), "стр").when(t.startswith("д"), "д").otherwise("")


def safe_modifiers(mods: Column) -> Column:
    t = normalized(mods)
    return F.when(t.isin(*NO_MODIFIERS), "").otherwise(t)


def joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "|")


def with_parts(df: DataFrame) -> DataFrame:
    """df with _st and _ho: the street and house slots, in the form of cards, taken apart. Each different text once."""
    for slot, text, to in (("street", "_street", "_st"), ("house", "_house", "_ho")):
        df = df.withColumn("_own", column(df, slot))
        forms = df.select(F.col("_own").alias("_raw")).distinct().withColumn("_form", F.coalesce(renormalized(slot, F.col("_raw")), F.col("_raw") if slot == "house" else F.lit("")))
        forms = A.parse_distinct(forms, "_form").withColumnsRenamed({"_form": text, "parsed": to})
        df = df.join(forms, F.col("_own") == F.col("_raw")).drop("_own", "_raw")
    return df


def digits(code: Column) -> Column:
    return F.regexp_replace(F.coalesce(code, F.lit("")), "[^0-9]+", "")


def scope_conflict(df: DataFrame, context: dict[str, str]) -> Column:
    """A row's code is neither that of the context nor begins it nor is begun by it, or its municipality or locality is another."""
    own, known = digits(column(df, "oktmo_code")), "".join(ch for ch in context.get("oktmo_code") or "" if ch.isdigit())
    out = F.lit(False)
    if known:
        out = (own != "") & ~own.startswith(known) & ~F.lit(known).startswith(own)
    for name in ("municipality", "locality"):
        if value := (context.get(name) or "").strip():
            out = out | ((column(df, name) != "") & (geo_key(column(df, name)) != geo_key(F.lit(value))))
    return out


def scope_key(df: DataFrame, context: dict[str, str] | None = None) -> Column:
    """The code or the places that a building's key is valid in: the context's, unless the row contradicts it, else the row's."""
    by_row = F.when(digits(column(df, "oktmo_code")) != "", F.concat(F.lit("oktmo:"), digits(column(df, "oktmo_code"))))
    places = normalized(F.concat_ws(" ", *[column(df, c) for c in ("municipality", "locality", "territory")]))
    by_row = F.coalesce(by_row, F.when(places != "", F.concat(F.lit("row:"), places)), normalized(column(df, "parsed_territory")))
    if not context:
        return by_row
    known = "".join(ch for ch in context.get("oktmo_code") or "" if ch.isdigit())
    named = normalized(F.lit(" ".join(context.get(c) or "" for c in ("municipality", "locality"))))
    of_context = F.lit(f"oktmo:{known}") if known else F.when(named != "", F.concat(F.lit("context:"), named))
    return F.coalesce(F.when(~scope_conflict(df, context), of_context), by_row)


def _slot_core(df: DataFrame) -> Column:
    st, ho = F.col("_st"), F.col("_ho")
    mods = F.when(ho["hm"] != "", ho["hm"]).otherwise(safe_modifiers(column(df, "house_mods")))
    core = joined(st["sw"], F.array_join(st["sn"], ","), house_kind_key(column(df, "house")), ho["hb"], mods, normalized(column(df, "premise")))
    return F.when((column(df, "street") != "") & (column(df, "house") != "") & (st["sw"] != "") & (ho["hb"] != ""), core)


def with_assembly_key(df: DataFrame, address: str, context: dict[str, str] | None = None) -> DataFrame:
    """df with assembly_key: `core|scope|street|numbers|kind|house|modifiers|premise` from the slots.

    Without a street and a house in the slots the same (without kind and premise) from the parsed
    address; without these its normalized text. A building of another kind, or in another scope,
    or another flat, is another key.
    """
    df = A.parsed(with_parts(df), address).withColumn("parsed_territory", F.col("parsed.ter"))
    p, scope = F.col("parsed"), scope_key(df, context)
    from_text = F.when((p["sw"] != "") & (p["hb"] != ""), joined(p["sw"], F.array_join(p["sn"], ","), p["hb"], p["hm"]))
    core = F.coalesce(_slot_core(df), from_text)
    return df.withColumn("assembly_key", F.coalesce(F.when(core.isNotNull(), joined(F.lit("core"), scope, core)), normalized(address))).drop("_street", "_house", "_st", "_ho", "parsed", "parsed_territory")


def vote_key(slot: str, value: Column, parsed: Column) -> Column:
    """What two spellings of a slot have in common if they are one vote; parsed: the value taken apart."""
    if slot == "street":
        return joined(F.lit("street"), parsed["sw"], F.array_join(parsed["sn"], ","))
    if slot == "house":
        return joined(F.lit("house"), house_kind_key(value), parsed["hb"], safe_modifiers(parsed["hm"]))
    if slot in GEO_SLOTS:
        geo = geo_key(value)
        return F.concat(F.lit(f"{slot}|"), F.when(geo != "", geo).otherwise(normalized(value)))
    return normalized(value)


def value_bonus(slot: str, value: Column) -> Column:
    if slot in PLACES:
        return F.lit(PLACE_BONUS)
    rules = {"postal_index": (value.rlike("^[1-6][0-9]{5}$"), INDEX_BONUS), "house": (normalized(value).rlike("(^| )д ?[0-9]"), HOUSE_BONUS), "street": (value.rlike(collect.HINTS), STREET_BONUS)}
    return F.when(rules[slot][0], rules[slot][1]).otherwise(0.0) if slot in rules else F.lit(0.0)


def value_penalty(slot: str, value: Column) -> Column:
    """A street, house or place that sanitize would reject counts less, so that it can't outvote a clean one."""
    named = sanitize.names_organisation(value) | sanitize.route_fragment(value) | sanitize.unbalanced(value)
    bad = {
        "street": (named | (~sanitize.explicit_street(value) & ~sanitize.plain_street(value)), STREET_PENALTY),
        "house": (~sanitize.ideal_house(value), HOUSE_PENALTY),
        "municipality": (named | ~sanitize.ideal_municipality(value), PLACE_PENALTY),
        "locality": (named | ~sanitize.ideal_locality(value), PLACE_PENALTY),
        "microdistrict": (named, PLACE_PENALTY),
        "territory": (named, TERRITORY_PENALTY),
    }
    return F.when(bad[slot][0], bad[slot][1]).otherwise(0.0) if slot in bad else F.lit(0.0)


def voted_slots(rows: DataFrame, group: str, slots: list[str], score: str, order: str) -> DataFrame:
    """group, slot, value, votes: the value of most rows; of equal counts that of the best score, then length, then the first.

    A value scores its row's score with its own bonus and penalty; one below 0 counts as 0. A vote
    shows as its best-scored spelling, the longest of equals; if all are below 0, as its first.
    """
    per_slot = [rows.select(group, order, F.col(score).cast("double").alias("_q"), F.lit(s).alias("slot"), F.coalesce(renormalized(s, F.col(s).cast("string")), clean(F.col(s).cast("string"))).alias("value")).where("value <> ''") for s in slots]
    scored = []
    for s, df in zip(slots, per_slot, strict=True):
        df = A.parsed(df, "value")
        v = F.col("value")
        scored.append(df.select(group, order, "slot", "value", vote_key(s, v, F.col("parsed")).alias("vote"), (F.col("_q") + value_bonus(s, v) - value_penalty(s, v)).alias("_v")))
    each = scored[0]
    for df in scored[1:]:
        each = each.unionByName(df)
    able = F.when(F.col("_v") >= 0, F.struct(F.col("_v").alias("score"), F.length("value").alias("len"), F.negative(order).alias("_o"), "value"))
    votes = each.where("vote <> ''").groupBy(group, "slot", "vote").agg(F.count("*").alias("votes"), F.max(able).alias("b"), F.min_by("value", order).alias("first"), F.min(order).alias("_first"))
    top = F.struct("votes", F.coalesce("b.score", F.lit(0.0)).alias("score"), F.coalesce("b.len", F.lit(0)).alias("len"), F.negative("_first").alias("_o"), F.coalesce("b.value", "first").alias("value"))
    return votes.groupBy(group, "slot").agg(F.max(top).alias("t")).select(group, "slot", F.col("t.value").alias("value"), F.col("t.votes").alias("votes"))


def with_final_keys(df: DataFrame, address: str) -> DataFrame:
    """df with core_key and text_key, blank where there is none: what makes two finished rows the same.

    The core is the street (or the microdistrict, or the territory), the house's kind, number and
    modifiers and the premise, within the code or the places of the row.
    """
    df = with_parts(df)
    st, ho = F.col("_st"), F.col("_ho")
    street = F.when(st["sw"] != "", joined(F.lit("street"), st["sw"], F.array_join(st["sn"], ","))).when(F.col("_street") != "", F.concat(F.lit("street-text|"), normalized("_street")))
    named = lambda c: F.when(column(df, c) != "", F.concat(F.lit(f"{c}|"), normalized(column(df, c))))
    locator = F.coalesce(street, named("microdistrict"), named("territory"))
    mods = F.when(ho["hm"] != "", ho["hm"]).otherwise(safe_modifiers(column(df, "house_mods")))
    core = joined(locator, house_kind_key(F.col("_house")), ho["hb"], mods, normalized(column(df, "premise")))
    code = digits(column(df, "oktmo_code"))
    places = normalized(F.concat_ws(" ", *[column(df, c) for c in ("subject", "municipality", "locality")]))
    scope = F.when(code != "", F.concat(F.lit("oktmo:"), code)).when(places != "", F.concat(F.lit("context:"), places)).otherwise("")
    keys = {"core_key": F.when((ho["hb"] != "") & locator.isNotNull(), joined(F.lit("core"), scope, core)).otherwise(""), "text_key": F.when(normalized(address) != "", F.concat(F.lit("address|"), normalized(address))).otherwise("")}
    return df.withColumns(keys).drop("_street", "_house", "_st", "_ho")


def duplicates_of(rows: DataFrame, order: str, keys: list[str], kept: DataFrame) -> DataFrame:
    """order, target: for each dropped row the earlier kept row that took its first key that is taken.

    kept: order, kept, as dedupe_by_any_key() gives it. A kept row owns all its keys alone, so this
    is one join on keys.
    """
    long = rows.select(order, F.posexplode(F.array(*[F.when(F.col(k) != "", F.concat(F.lit(f"{k}="), F.col(k))) for k in keys])).alias("_i", "_k")).where("_k is not null")
    owners = long.join(kept.where("kept"), order, "left_semi").select("_k", F.col(order).alias("target"))
    met = long.join(kept.where("not kept"), order, "left_semi").join(owners, "_k").where(F.col("target") < F.col(order))
    return met.groupBy(order).agg(F.min_by("target", "_i").alias("target"))


def merged_examples(rows: DataFrame, pointers: DataFrame, order: str, column_: str, most: int, sep: str) -> DataFrame:
    """target, column_: the first `most` different parts of a kept row's text and of those that flow to it, in order of rows.

    Cut before they meet, so a row that many flow to doesn't gather them.
    """
    parts = rows.join(pointers, order, "left").select(F.coalesce("target", order).alias("target"), F.col(order).alias("_o"), F.posexplode(F.split(F.coalesce(F.col(column_).cast("string"), F.lit("")), F.lit("\\Q" + sep + "\\E"))).alias("_i", "_p"))
    first = parts.withColumn("_p", F.btrim("_p")).where("_p <> ''").groupBy("target", "_p").agg(F.min(F.struct("_o", "_i")).alias("_at"))
    rank = F.row_number().over(Window.partitionBy("target").orderBy("_at"))
    kept = first.withColumn("_r", rank).where(F.col("_r") <= most)
    return kept.groupBy("target").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_p"))), lambda x: x["_p"]), sep).alias(column_))


def dedupe_merging(rows: DataFrame, order: str, keys: list[str], count: str = "source_count", texts: dict[str, tuple[int, str]] | None = None) -> DataFrame:
    """Rows that stay in the final dedupe (no earlier row that stays has one of their keys), with what dropped rows carried.

    A dropped row's count (1 where it has none) is added to that of the row that took its key; its
    texts (`most`, separator: raw examples, sources) go behind that row's own, each part once.
    """
    texts = texts or {}
    rows = settled(rows, "rows")
    kept = settled(collect.dedupe_by_any_key(rows, order, keys), "kept")
    pointers = settled(duplicates_of(rows, order, keys, kept), "pointers")
    own = F.when(F.coalesce(F.col(count).cast("long"), F.lit(0)) == 0, 1).otherwise(F.col(count).cast("long"))
    sums = rows.join(pointers, order, "left").groupBy(F.coalesce("target", order).alias("target")).agg(F.sum(own).alias(count))
    out = rows.drop(count, *texts).join(kept.where("kept"), order, "left_semi").join(sums.withColumnRenamed("target", order), order)
    for name, (most, sep) in texts.items():
        out = out.join(merged_examples(rows, pointers, order, name, most, sep).withColumnRenamed("target", order), order, "left")
    return out


def assembled(rows: DataFrame, address: str, slots: list[str], score: str, order: str, context: dict[str, str] | None = None) -> DataFrame:
    """A row for each assembly key: the best row's address and order, its slots by vote, how many candidates it has.

    The best row has the greatest score, then the shortest address, then comes first. Slots that the
    votes leave blank are filled from the context.
    """
    keyed = settled(with_assembly_key(rows, address, context), "keyed")
    best = F.max_by(F.struct(address, order), F.struct(score, F.negative(F.length(address)), F.negative(order))).alias("b")
    base = keyed.groupBy("assembly_key").agg(best, F.count("*").alias("candidate_count"), F.round(F.max(score), 3).alias("best_score")).select("assembly_key", "b.*", "candidate_count", "best_score")
    votes = voted_slots(keyed, "assembly_key", slots, score, order).groupBy("assembly_key").pivot("slot", slots).agg(F.first("value"))
    out = base.join(votes, "assembly_key", "left")
    fill = {s: F.coalesce(s, F.lit(v)) for s, v in (context or {}).items() if s in slots and v}
    bad_house = {"house": F.when(~sanitize.invalid_house(F.regexp_extract("house", "([0-9]+[а-яa-z]?)", 1)), F.col("house"))} if "house" in slots else {}
    return out.withColumns(fill | bad_house) if fill or bad_house else out
