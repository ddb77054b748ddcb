"""Is this row an address: predicates on slots, the first reason to drop a row, its issues, its score.

A row is a mapping from slot names to Columns: address, raw, street, territory, microdistrict,
house, house_base, municipality, locality, sources, scope_valid, scope_code, code. Slots that are
not given count as blank, and null, blank and `nan` are one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.address import L, R
from plumbline.functions.text import clean, clean_once, let, normalized
from plumbline.operators.collect import codes_conflict
from plumbline.sources.scratch import settled

MOST_CHARS, CORE_CHARS = 700, 1200
#: Words of organisations and of routes in collected rows (whole words; the latter anywhere).
ORGANISATION_WORDS = ("маоу", "мадоу", "мбоу", "мбдоу", "моу", "гбоу", "фгбоу", "чоу", "ано", "сош", "оош", "нош", "гимназия", "лицей", "школа", "детский сад", "дошкольное образовательное учреждение", "образовательное учреждение", "колледж", "техникум", "университет", "академия")
ROUTE_WORDS = ("подвоз", "маршрут", "маршруты", "количество детей км", "информация о подвозе")
#: The same for issue codes of finished rows.
OBJECT_STEMS = ("школа", "сош", "оош", "ноо", "лицей", "гимназия", "детск\\w* сад", "садик", "доу", "колледж", "техникум", "училищ\\w*", "университет", "академия", "институт", "учрежден\\w*", "организац\\w*")
ROUTE_STEMS = ("автобусн\\w* маршрут", "маршрут", "остановочн\\w+ пункт", "остановка", "дорога к ", "трасса", "автодорог\\w*")
#: What marks a street, a house, a district; what is too general alone; what a dumped table row holds.
STREET_WORDS = ("улица", "ул", "переулок", "пер", "пр-кт", "пркт", "проспект", "просп", "шоссе", "ш", "проезд", "пр-д", "б-р", "бр", "бульвар", "набережная", "наб", "площадь", "пл", "тупик", "аллея", "линия")
STREET_ENDS = ("тракт", "тракта", "шоссе", "проезд", "бульвар", "переулок", "проспект", "набережная", "площадь")
HOUSE_WORDS = ("дом", "д", "здание", "зд", "строение", "стр")
DISTRICT_WORDS = ("микрорайон", "мкр", "квартал", "кв-л")
GENERAL_WORDS = ("федеральный округ", "область", "край", "республика", "автономный округ", "муниципальный округ", "муниципальный район", "городской округ", "город ", "г ")
SUBJECT_KINDS = ("область", "край", "республика", "автономный округ", "федеральный округ")
DUMP_WORDS = ("планируемый срок", "примечение", "примечание", "площадь учебная", "количество обучающихся", "требуемая учебная площадь", "дополнительная потребность", "кадастровый номер", "column")
PLACE_KINDS = ("город", "г", "село", "с", "деревня", "д", "поселок", "посёлок", "пос", "п", "пгт", "рп")

SLOTS = ("address", "raw", "street", "territory", "microdistrict", "house", "house_base", "municipality", "locality", "sources", "scope_code", "code")


def _words(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


def _text(c: Column | None) -> Column:
    return F.lit("") if c is None else F.coalesce(clean(c.cast("string")), F.lit(""))


def _row(row: dict[str, Column], text: Callable[[Column | None], Column] = _text) -> dict[str, Column]:
    out = {k: text(row.get(k)) for k in SLOTS}
    out["raw"] = F.when(out["raw"] != "", out["raw"]).otherwise(out["address"])
    out["house_base"] = F.when(out["house_base"] != "", F.lower(out["house_base"])).otherwise(F.lower(F.regexp_extract(out["house"], "(?iuU)\\b(?:д\\.?|дом)?\\s*([0-9]+[а-яa-z]?)\\b", 1)))
    return out


#: Slots whose normalized texts the rules of rows ask for.
KEYED = ("address", "raw", "street", "territory", "microdistrict", "municipality", "locality", "sources")


def _asked(row: dict[str, Column], rule: Callable[[dict[str, Column], dict[str, Column]], Column], either: bool = False) -> Column:
    """What a rule makes of a row's slots and their normalized texts, all worked out once a row, however many questions it asks.

    either: a row without an address has its raw text as one.
    """
    given = [k for k in SLOTS if row.get(k) is not None]
    there = {*given, "address", "raw", "house_base"}
    blank = {k: F.lit("") for k in SLOTS}

    def of_texts(texts: Column) -> Column:
        r = _row({k: texts[k] for k in given}, lambda c: F.lit("") if c is None else c)
        if either:
            r["address"] = F.when(r["address"] != "", r["address"]).otherwise(r["raw"])
        made = F.struct(*[r[k].alias(k) for k in SLOTS if k in there])
        return let(made, of_row)

    def of_row(r: Column) -> Column:
        # most raw texts are the address itself
        key = lambda k, address: address if k == "address" else F.when(r[k] == r["address"], address).otherwise(normalized(r[k])) if k == "raw" else normalized(r[k])
        made = let(normalized(r["address"]), lambda address: F.struct(*[key(k, address).alias(k) for k in KEYED if k in there]))
        return let(made, lambda k: rule(blank | {x: r[x] for x in there}, blank | {x: k[x] for x in KEYED if x in there}))

    squeezed = lambda c: F.coalesce(clean_once(c.cast("string")), F.lit(""))
    return let(F.struct(*([squeezed(row[k]).alias(k) for k in given] or [F.lit("").alias("address")])), of_texts)


def _key(text: Column, key: Column | None) -> Column:
    return normalized(text) if key is None else key


def has_street_word(text: Column) -> Column:
    return text.rlike(f"{L}{_words(STREET_WORDS)}{R}")


def has_district_word(text: Column) -> Column:
    return text.rlike(f"{L}{_words(DISTRICT_WORDS)}{R}")


def names_organisation(text: Column, key: Column | None = None) -> Column:
    """A word of ORGANISATION_WORDS stands in the normalized text (key, if it is known)."""
    return F.concat(F.lit(" "), _key(text, key), F.lit(" ")).rlike(f" {_words(ORGANISATION_WORDS)} ")


def route_fragment(text: Column, key: Column | None = None) -> Column:
    """Words of a route, a dash between two places one of which is an organisation, or a numbered one."""
    dashed = text.rlike("(?U)\\s[-–—]\\s") & (names_organisation(text, key) | text.rlike(f"{L}(?:с/о|дк|жк){R}"))
    return _key(text, key).rlike(_words(ROUTE_WORDS)) | dashed | (text.rlike("(?U)^\\s*[0-9]+\\.\\s+") & names_organisation(text, key))


def unbalanced(text: Column, pairs: tuple[str, ...] = ("()", "«»")) -> Column:
    out = F.lit(False)
    for a, b in pairs:
        without = lambda c: F.length(F.replace(text, F.lit(c), F.lit("")))
        out = out | (without(a) != without(b))
    return out


def dumped_table(text: Column, key: Column | None = None) -> Column:
    """A row of a table written into one cell."""
    marked = text.contains("|") | F.lower(text).contains("column_")
    return marked & F.coalesce(_key(text, key).rlike(_words(DUMP_WORDS)), F.lit(False))


def subject_only(text: Column, key: Column | None = None) -> Column:
    return _key(text, key).rlike(f"^(?:[а-я ]+ )?{_words(SUBJECT_KINDS)}$")


def too_general(row: dict[str, Column]) -> Column:
    """A place with no street, territory, district or house."""
    return _asked(row, _too_general)


def _too_general(r: dict[str, Column], k: dict[str, Column]) -> Column:
    empty = (r["street"] == "") & (r["territory"] == "") & (r["microdistrict"] == "") & (r["house_base"] == "")
    told = has_street_word(r["address"]) | has_district_word(r["address"]) | r["address"].rlike(f"{L}{_words(HOUSE_WORDS)}\\.?\\s*[0-9]")
    return empty & ~told & k["address"].rlike(_words(GENERAL_WORDS))


def invalid_house(base: Column) -> Column:
    return F.lower(F.btrim(base)).rlike("^0+[а-яa-z]?$")


def address_core(address: Column, street: Column, house_base: Column, territory: Column, most: int = CORE_CHARS) -> Column:
    """A street or a territory, with a house, in a text of at most `most` characters."""
    return (F.length(address) <= most) & (_text(house_base) != "") & ((_text(street) != "") | (_text(territory) != ""))


def looks_like_address(text: Column, street: Column, house_base: Column) -> Column:
    """A street word and a street or a house, or both of these without it."""
    s, h = _text(street) != "", _text(house_base) != ""
    return F.coalesce((has_street_word(text) & (s | h)) | (s & h), F.lit(False))


def ideal_municipality(text: Column, key: Column | None = None) -> Column:
    key = _key(text, key)
    kind = key.contains("муниципаль") | key.contains("городской округ") | F.concat(F.lit(" "), key, F.lit(" ")).rlike(" (?:район|округ) ") | key.rlike("^(?:город|г) [а-яa-z0-9 ]+$")
    return kind & ~has_street_word(text) & ~has_district_word(text)


def ideal_locality(text: Column) -> Column:
    """The kind of a place and then its name, of letters, digits, dashes, dots and apostrophes; no street, no district."""
    def placed(words: Column) -> Column:
        named = F.forall(F.slice(words, 2, 1000), lambda w: w.rlike("^[а-яёa-z0-9.'-]+$"))
        return (F.size(words) > 1) & F.rtrim(words[0], F.lit(".")).isin(*PLACE_KINDS) & named

    return let(F.split(F.btrim(F.lower(text)), "\\s+"), placed) & ~has_street_word(text) & ~has_district_word(text)


def explicit_street(text: Column, key: Column | None = None) -> Column:
    """A street word before the name, or after it."""
    return text.rlike(f"(?iuU)^\\s*{_words(STREET_WORDS)}\\.?\\s+") | (text.rlike(f"{L}{_words(STREET_ENDS)}\\s*$") & ~names_organisation(text, key))


def plain_street(text: Column, key: Column | None = None) -> Column:
    """One to four words of a name, not all of them numbers."""
    key = _key(text, key)
    return F.size(F.split(key, " ")).between(1, 4) & key.rlike("[а-яa-z]") & ~text.rlike("[()|;:]") & ~names_organisation(text, key) & ~route_fragment(text, key) & ~key.rlike(_words(GENERAL_WORDS[:8]))


#: How a card writes what stands before a house's number, and before the numbers of its parts.
HOUSE_KINDS, PART_KINDS = ("д.", "зд.", "стр."), ("к", "корп", "стр", "с", "лит")


def ideal_house(text: Column) -> Column:
    """As cards write it: a kind with its dot and a number; then, behind commas, parts with a kind and a number or letter."""
    number = lambda x, least: F.regexp_replace(x, "[а-яa-z]$", "").rlike(f"^[0-9]{{{least},4}}$")
    behind = lambda x, kind: F.btrim(F.substring(x, F.lit(len(kind) + 1), F.length(x)))
    one_of = lambda x, kinds, fits: reduce(lambda a, b: a | b, [x.startswith(k) & fits(behind(x, k)) for k in kinds])
    house = lambda p: one_of(p, HOUSE_KINDS, lambda x: number(x, 1))
    part = lambda p: one_of(p, PART_KINDS, lambda x: number(F.ltrim(F.ltrim(x, F.lit("."))), 0))
    return let(F.transform(F.split(F.lower(text), ","), lambda p: F.btrim(p)), lambda parts: let(parts[0], house) & F.forall(F.slice(parts, 2, 1000), part))


def slot_reason(row: dict[str, Column]) -> Column:
    """The first slot that can't be right, or null."""
    return _asked(row, _slot_reason)


def _slot_reason(r: dict[str, Column], k: dict[str, Column]) -> Column:
    organisation, route = ({s: asks(r[s], k[s]) for s in KEYED} for asks in (names_organisation, route_fragment))
    from_route = k["sources"].rlike(_words(ROUTE_WORDS))
    out = F.when(from_route & (organisation["raw"] | organisation["street"] | route["raw"] | route["street"]), "route_source_fragment")
    out = out.when(organisation["address"], "object_name_in_address").when(route["address"], "route_fragment_in_address")
    for slot in ("municipality", "locality", "territory", "microdistrict"):
        there = r[slot] != ""
        out = out.when(there & organisation[slot], f"object_name_in_{slot}_slot").when(there & route[slot], f"route_fragment_in_{slot}_slot").when(there & unbalanced(r[slot]), f"unbalanced_{slot}_slot")
        if slot == "municipality":
            out = out.when(there & ~ideal_municipality(r[slot], k[slot]), "invalid_municipality_slot")
        if slot == "locality":
            out = out.when(there & ~ideal_locality(r[slot]), "invalid_locality_slot")
    street = r["street"] != ""
    out = out.when(street & organisation["street"], "object_name_in_street_slot").when(street & route["street"], "route_fragment_in_street_slot")
    out = out.when(street & unbalanced(r["street"]), "unbalanced_street_fragment").when(street & ~explicit_street(r["street"], k["street"]) & ~plain_street(r["street"], k["street"]), "invalid_street_slot")
    out = out.when((r["house"] != "") & (~ideal_house(r["house"]) | unbalanced(r["house"])), "invalid_house_slot")
    return out.when(unbalanced(r["address"]) | unbalanced(r["street"]), "unbalanced_address_fragment")


def drop_reason(row: dict[str, Column]) -> Column:
    """The first reason to reject a collected row, or null: its text, its core, its scope, its slots."""
    valid = F.coalesce(row["scope_valid"], F.lit(False)) if "scope_valid" in row else F.lit(False)
    digits = lambda c: F.regexp_replace(c, "[^0-9]+", "")

    def rule(r: dict[str, Column], k: dict[str, Column]) -> Column:
        place = (r["street"] != "") | (r["territory"] != "") | (r["microdistrict"] != "")
        return (
            F.when(r["address"] == "", "empty_address")
            .when(F.length(r["address"]) > MOST_CHARS, "address_too_long")
            .when(dumped_table(r["raw"], k["raw"]) | dumped_table(r["address"], k["address"]), "contaminated_table_dump")
            .when(subject_only(r["address"], k["address"]), "subject_only_address")
            .when(_too_general(r, k), "too_general_location")
            .when((r["house_base"] == "") & place, "street_without_house")
            .when(r["house_base"] == "", "no_house")
            .when(invalid_house(r["house_base"]), "invalid_house_number")
            .when(~place, "house_without_street_or_territory")
            .when(valid & codes_conflict(digits(r["scope_code"]), digits(r["code"])), "oktmo_scope_conflict")
            .otherwise(_slot_reason(r, k))
        )

    return _asked(row, rule)


def issue_codes(row: dict[str, Column]) -> Column:
    """All that is wrong with a finished row, in a fixed order; an empty array if nothing is."""
    stems = lambda text, words: F.translate(F.lower(text), "ё", "е").rlike(f"{L}{_words(words).replace(' ', '\\s+')}")
    square = ("()", "[]")

    def rule(r: dict[str, Column], k: dict[str, Column]) -> Column:
        place = (r["street"] != "") | (r["territory"] != "") | (r["microdistrict"] != "")
        house = F.when((r["house_base"] == "") & place, "street_without_house").when(r["house_base"] == "", "no_house").when(invalid_house(r["house_base"]), "invalid_house_number").when(~place, "house_without_street_or_territory")
        codes = F.array(
            F.when(F.length(r["address"]) > MOST_CHARS, "address_too_long"),
            F.when(subject_only(r["address"], k["address"]), "subject_only_address"),
            F.when(_too_general(r, k), "too_general_location"),
            house,
            F.when(stems(r["address"], OBJECT_STEMS), "object_name_in_address"),
            F.when(stems(r["address"], ROUTE_STEMS) | ((r["raw"] != r["address"]) & stems(r["raw"], ROUTE_STEMS)), "route_fragment_in_address"),
            F.when(unbalanced(r["address"], square) | unbalanced(r["street"], square), "unbalanced_address_fragment"),
        )
        return F.when(r["address"] == "", F.array(F.lit("empty_address"))).otherwise(F.array_compact(codes))

    return _asked(row, rule, either=True)


def issue_samples(rows: DataFrame, address: str, issues: str = "issues", order: str = "row_idx", most: int = 5) -> DataFrame:
    """issue, n_rows, samples: the first `most` addresses of each issue, cut before they meet; rows without any count as clean."""
    # counts and samples both read the issues, which are worked out once
    rows = settled(rows.select(order, address, issues), "issues")
    each = rows.select(order, address, F.explode(F.when(F.size(issues) == 0, F.array(F.lit("clean"))).otherwise(F.col(issues))).alias("issue"))
    first = F.row_number().over(Window.partitionBy("issue").orderBy(order))
    shown = each.where((F.col("issue") != "clean") & (F.btrim(address) != "")).withColumn("_n", first).where(F.col("_n") <= most)
    listed = shown.groupBy("issue").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", address))), lambda x: x[address]), " | ").alias("samples"))
    return each.groupBy("issue").agg(F.count("*").alias("n_rows")).join(listed, "issue", "left")


def quality(row: dict[str, Column], filled: Column, kind: Column, scope_bonus: Column | None = None) -> Column:
    """Score of a candidate. row: also postal_index, normalized; filled: number of filled slots; kind: of its source."""
    r = _row(row)
    has = lambda c: F.when(_text(c) != "", 1.0).otherwise(0.0)
    normal = _text(row.get("normalized"))
    score = 35.0 * has(r["house_base"]) + 25.0 * F.when((r["street"] != "") | (r["territory"] != ""), 1.0).otherwise(0.0) + 14.0 * has(r["code"]) + 8.0 * has(row.get("postal_index"))
    score = score + F.least(F.length(normal), F.lit(140)) * 0.05 + filled * 0.8
    score = score + F.when(kind == "existing_reference", 12.0).otherwise(0.0) + F.when(kind.contains("reference") | kind.contains("address"), 6.0).otherwise(0.0)
    over = F.length(r["raw"]) - 450
    score = score - F.when(over > 0, F.least(over / 20.0, F.lit(20.0))).otherwise(0.0) - F.when(dumped_table(r["raw"]), 35.0).otherwise(0.0)
    score = score + F.when((normal != "") & (normalized(normal) == normalized(r["raw"])), 2.0).otherwise(0.0)
    return score if scope_bonus is None else score + F.coalesce(scope_bonus, F.lit(0.0))


def merged_groups(rows: DataFrame, group: str, slots: list[str], score: str, raw: str, order: str, context: DataFrame | None = None) -> DataFrame:
    """A row for each group: slots by vote (count, then score, then length), the best score, counts, up to five examples.

    context: one row of values that fill slots the votes leave blank.
    """
    from plumbline.operators.collect import slot_votes
    from plumbline.operators.reference import merge_rows

    votes = slot_votes(rows, group, slots, score).groupBy(group).pivot("slot", slots).agg(F.first("value"))
    base = merge_rows(rows, group, order, [], raw).withColumnRenamed("source_count", "candidate_count")
    best = rows.groupBy(group).agg(F.round(F.max(score), 3).alias("best_score"))
    out = base.join(best, group).join(votes, group, "left")
    if context is not None:
        known = context.limit(1).select(*[F.col(c).alias(f"_{c}") for c in context.columns])
        out = out.join(F.broadcast(known), F.lit(True), "left").withColumns({c: F.coalesce(c, f"_{c}") for c in context.columns if c in slots}).drop(*known.columns)
    house = F.col("house") if "house" in slots else F.lit("")
    return out.withColumn("house", F.when(~invalid_house(F.regexp_extract(house, "([0-9]+[а-яa-z]?)", 1)), F.col("house"))) if "house" in slots else out


def street_houses(text: str) -> list[tuple[str, str]]:
    """Streets with a house behind them: word by word between stops, streets whose kind comes first before the others.

    Brackets, semicolons and dashes with blanks end a clause, commas a part of it. A street is its
    kind and a name, or a name and its kind; its house ends the part, or is all of the next one.
    Parts that only name buildings or blocks of the house go on with it.
    """
    first, last = [], []
    for clause in CLAUSES.split(re.sub(r"(?<=[^\W\d])\.(?=\w)", ". ", text)):
        parts = [p.split() for p in clause.split(",")]
        for i, words in enumerate(parts):
            bare = [w.lower().strip(".") for w in words]
            at = next((k for k, w in enumerate(bare) if w in STREET_WORDS), None)
            end = next((k for k, w in enumerate(bare) if k and w in STREET_ENDS), None)
            for out, start, name_end in ((first, at, None if at is None else at + 2), (last, 0, None if end is None else end + 1)):
                if name_end is None or name_end > len(words):
                    continue
                k = next((k for k in range(name_end, len(words)) if _is_house(bare[k:])), len(words))
                house, more = words[k:], i + 1
                if not house and more < len(parts) and _is_house([w.lower().strip(".") for w in parts[more]]):
                    house, more = parts[more], more + 1
                if house:
                    while more < len(parts) and parts[more] and parts[more][0].lower().strip(".") in PART_WORDS and len(parts[more]) < 3:
                        house, more = [*house, *parts[more]], more + 1
                    out.append((" ".join(words[start:k]), " ".join(house)))
                    break
    return first + last


CLAUSES = re.compile(r"[;()\n]|\s[-–—]\s")
PART_WORDS = ("корпус", "корп", "к", "строение", "стр", "с", "литера", "лит")
NUMBER = re.compile(r"[0-9]{1,4}[а-яa-z]?(?:[-/][0-9а-яa-z]+)?")


def _is_house(words: list[str]) -> bool:
    """A number, with or without its word, that is no ordinal; then only parts of the house."""
    words = words[1:] if words and words[0] in HOUSE_WORDS else words
    if not words or not NUMBER.fullmatch(words[0]) or words[0].rpartition("-")[2] in ORDINAL_ENDS:
        return False
    return all(w in PART_WORDS or NUMBER.fullmatch(w) or len(w) == 1 for w in words[1:]) and (len(words) < 2 or words[1] not in ORDINAL_ENDS)


ORDINAL_ENDS = ("я", "ая", "й", "ой")


@F.pandas_udf(T.ArrayType(T.StructType().add("street", T.StringType()).add("house", T.StringType())))
def _told_houses(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"street": s, "house": h} for s, h in street_houses(t or "")])


def address_fragments(text: Column, most: int = 8) -> Column:
    """The last `most` different `street, house` pieces of a text, written as cards write them.

    Text of 8 to 1200 characters. A number that is a street's ordinal is no house; places in
    brackets with an organisation, from which a route goes on, and streets that can't be right
    are left out.
    """
    from plumbline.functions.slots import renormalized

    t = _text(text)
    fits = F.length(t).between(8, CORE_CHARS)
    # texts of other lengths don't go to Python at all
    told = F.regexp_replace(F.when(fits, t), f"(?iuU)\\([^()]*{L[6:]}{_words(ORGANISATION_WORDS)}{R}[^()]*\\)(?=\\s+[-–—]\\s|\\s*(?:с/о|дк|жк|кп|мкр){R})", "")

    def piece(x: Column) -> Column:
        def written(street: Column, number: Column, key: Column) -> Column:
            fits = explicit_street(street, key) & ideal_house(number) & ~names_organisation(street, key) & ~route_fragment(street, key) & ~unbalanced(street)
            return F.when(fits, F.concat(F.btrim(street, F.lit(" ,")), F.lit(", "), number))

        return let(renormalized("street", x["street"]), lambda s: let(normalized(s), lambda k: let(renormalized("house", x["house"]), lambda n: written(s, n, k))))

    found = _told_houses(told)
    pieces = F.array_distinct(F.array_compact(F.transform(found, piece)))
    kept = let(pieces, lambda p: F.slice(p, F.greatest(F.lit(1), F.size(p) - most + 1), most))
    return F.when(fits, kept).otherwise(F.array().cast("array<string>"))
