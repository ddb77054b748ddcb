"""Address slots: a string as the named parts of a card, and the card as a line again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import address as A
from plumbline.functions.text import clean, clean_once, let, level_key, normalized, postal_index
from plumbline.operators.reference import construct_address

#: Slots of a line in order, and technical ones.
LINE_SLOTS = ("postal_index", "federal_district", "parent_subject", "subject", "autonomous_okrug", "municipality", "locality", "territory", "microdistrict", "street", "house", "premise")
TECHNICAL_SLOTS = ("oktmo_code", "oktmo_name", "house_base", "house_mods", "house_modifiers", "street_numbers", "territory_key", "match_key")
DEFAULT_OFF = ("microdistrict",)
#: How a street type is written, by the spellings that mean it.
STREET_FORMS = (
    ("ул.", ("улица", "ул")),
    ("пер.", ("переулок", "пер")),
    ("пр-кт", ("проспект", "просп", "пр-кт", "пр-т", "прт")),
    ("пр-д", ("проезд", "пр-д")),
    ("б-р", ("бульвар", "бульв", "б-р")),
    ("наб.", ("набережная", "наб")),
    ("пл.", ("площадь", "пл")),
    ("туп.", ("тупик", "туп")),
    ("ш.", ("шоссе", "ш")),
    ("проул.", ("проулок", "проул")),
)
LOCALITY_FORMS = (("г.", ("город", "г")), ("п.", ("поселок", "посёлок", "пос", "п")), ("д.", ("деревня", "д")), ("с.", ("село", "с")), ("х.", ("хутор", "х")), ("ст-ца", ("станица",)), ("р.п.", ("рабочий поселок", "рп")))
#: Header words by slot, asked in this order.
HEADER_SLOTS = (("street", ("улица", "street")), ("house", ("номер дома", "дом", "house")), ("postal_index", ("индекс", "postal")), ("locality", ("населенный пункт", "город", "locality")), ("municipality", ("муницип", "городской округ")), ("subject", ("регион", "субъект", "область")), ("microdistrict", ("микрорайон", "мкр", "квартал")), ("territory", ("территория",)), ("oktmo_code", ("код октмо",)), ("oktmo_name", ("октмо",)), ("address", ("адрес", "местонахождение", "address")))
SUBJECT = f"{A.L}(?:область|обл|край|республика|респ|автономный\\s+округ){A.R}"
MUNICIPALITY = f"{A.L}(?:район|р-н|муниципальный|городской\\s+округ){A.R}"
MICRODISTRICT = f"{A.L}(?:микрорайон|мкр|квартал|кв-л){A.R}"
TERRITORY = f"{A.L}(?:тер|территория|снт|сосн|днт|тсн){A.R}"
ROOM = f"(?iuU)^\\s*{A._any(A.ROOMS)}{A.R}\\.?\\s*№?\\s*[0-9]"
#: A house, but not the number of a street as in `5-я линия`.
HOUSE = f"(?iuU)^\\s*(?:(?:дом|д|здание|зд|строение|стр)\\.?\\s*)?[0-9]+(?![0-9])(?!\\s*-?\\s*{A._any(A.ORDINALS)}{A.R})"


def header_slot(header: Column) -> Column:
    """The slot that a header names, or null."""

    def named(h: Column) -> Column:
        out = F.lit(None).cast("string")
        for slot, words in reversed(HEADER_SLOTS):
            hit = F.lit(False)
            for w in words:
                hit = hit | h.contains(w)
            out = F.when(hit, slot).otherwise(out)
        return out

    return let(normalized(header), named)


def segments(raw: Column) -> Column:
    """Comma-separated parts, with a blank after an abbreviation's dot, without blanks and postal indexes."""
    spaced = F.regexp_replace(F.coalesce(clean(raw), F.lit("")), "(?U)(?<=\\p{L}\\.)(?=[\\p{L}0-9])", " ")
    parts = F.transform(F.split(spaced, ","), lambda s: F.btrim(s))
    return F.filter(parts, lambda s: (s != "") & ~s.rlike("^[0-9]{6}$"))


def _formed(text: Column, forms) -> Column:
    for to, spellings in forms:
        text = F.regexp_replace(text, f"(?iuU)^{A._any(spellings)}{A.R}\\.?\\s+", f"{to} ")
    return text


def street_display(raw: Column) -> Column:
    """Street types in their usual spelling; a repeated type, a building's name and a house tail go."""
    text = F.btrim(F.regexp_replace(raw, "(?U)(?<=\\p{L}\\.)(?=\\p{L})", " "))
    text = F.regexp_replace(text, f"(?iuU)\\s+(?:жк|жилой\\s+комплекс){A.R}.*$", "")
    text = F.regexp_replace(text, f"(?iuU)^{A._any(A.STREET_TYPES)}{A.R}\\.?\\s+(?={A._any(A.STREET_TYPES)}{A.R}\\.?\\s+\\S)", "")
    # a bare `пр.` before a name of many is a passage, else an avenue
    text = F.regexp_replace(text, "(?iuU)^пр\\.?\\s+(?=\\S+(?:ов|ев)$)", "пр-д ")
    text = F.regexp_replace(text, "(?iuU)^пр\\.?\\s+", "пр-кт ")
    return _formed(F.btrim(F.regexp_replace(text, f"(?iuU)[\\s,]+(?:дом|д)\\.?\\s*[0-9].*$", "")), STREET_FORMS)


def house_kind(text: Column) -> Column:
    """д, зд or стр: what a house's own text begins with; д if with nothing."""
    first = F.regexp_extract(F.lower(F.btrim(text)), "^([а-яa-z]+)", 1)
    return F.when(first.isin("зд", "здание"), "зд").when(first.isin("стр", "строение"), "стр").otherwise("д")


def house_display(base: Column, mods: Column, kind: Column | None = None) -> Column:
    """`д. 10А, к. 2, стр. 1, лит. Б` from a house number, canonical modifiers and its kind; null without a number."""
    plain = F.upper(F.regexp_extract(mods, "^((?!лит)[а-яa-z](?![0-9]))", 1))
    parts = [F.when(F.regexp_extract(mods, p, 1) != "", F.concat(F.lit(f"{name} "), F.upper(F.regexp_extract(mods, p, 1)))) for name, p in (("к.", "к([0-9]+[а-яa-z]?)"), ("стр.", "с([0-9]+[а-яa-z]?)"), ("лит.", "лит([а-яa-z])"))]
    return F.when(base != "", F.array_join(F.array_compact(F.array(F.concat(F.lit("д") if kind is None else kind, F.lit(". "), base, plain), *parts)), ", "))


def modifiers_list(mods: Column) -> Column:
    return F.regexp_extract_all(mods, F.lit("лит[а-яa-z]|[кс][0-9]+[а-яa-z]?|[а-яa-z]"), F.lit(0))


def _pick(segs: Column, wanted, last: bool = False) -> Column:
    found = F.filter(segs, wanted)
    return F.when(F.size(found) > 0, F.element_at(found, -1 if last else 1))


def with_slots(df: DataFrame, raw: str, city: str = "") -> DataFrame:
    """df with the struct `slots`; fields that the text doesn't hold are null.

    A bare name after a place is a street. Each different string is taken apart once.
    """
    once = A.parse_distinct(df.select(F.col(raw).alias("_raw")).distinct().withColumn("_seg0", segments(F.col("_raw"))), "_raw", city, True)
    seg = F.col("_seg0")
    is_place = f"(?iuU)^\\s*{A.SETTLEMENT}\\s*\\S"
    special = lambda s: s.rlike(SUBJECT) | s.rlike(MUNICIPALITY) | s.rlike(is_place) | s.rlike(MICRODISTRICT) | s.rlike(TERRITORY) | s.rlike(ROOM) | s.rlike(HOUSE)
    typed = _pick(seg, lambda s: s.rlike(A.STREET) & ~s.rlike(MICRODISTRICT) & ~s.rlike(HOUSE))
    bare = _pick(seg, lambda s: ~special(s) & ~s.rlike(A.STREET) & s.rlike("(?U)^[\\p{Lu}0-9][\\p{L}0-9 .-]*$"), last=True)
    place = _pick(seg, lambda s: s.rlike(is_place) & ~s.rlike(SUBJECT) & ~s.rlike(MUNICIPALITY) & ~s.rlike("(?iuU)^д\\.?\\s*[0-9]"), last=True)
    place_only = F.regexp_replace(place, f"(?iuU)^({A.SETTLEMENT}\\s*\\S+(?:\\s+(?!{A._any(A.STREET_TYPES)}{A.R})\\S+)*)\\s+{A._any(A.STREET_TYPES)}{A.R}.*$", "$1")
    base, mods = F.col("parsed.hb"), F.col("parsed.hm")
    blank = lambda: F.lit(None).cast("string")
    # the house at the end of a street's own segment
    typed = F.when(base != "", F.regexp_replace(typed, f"(?iuU)[\\s,]+(?:(?:дом|д)\\.?\\s*)?[0-9]+{A.TAIL}\\s*$", "")).otherwise(typed)
    street = F.coalesce(street_display(F.regexp_replace(typed, f"(?iuU)^{A.SETTLEMENT}\\s*\\S+\\s+(?={A._any(A.STREET_TYPES)}{A.R})", "")), F.when(base != "", F.concat(F.lit("ул. "), bare)))
    slots = {
        "postal_index": postal_index("_raw"),
        "federal_district": blank(),
        "parent_subject": blank(),
        "subject": _pick(seg, lambda s: s.rlike(SUBJECT)),
        "autonomous_okrug": _pick(seg, lambda s: s.rlike("(?iuU)автономный\\s+округ|(?<!\\S)ао(?!\\S)")),
        "municipality": _pick(seg, lambda s: s.rlike(MUNICIPALITY) & ~s.rlike(SUBJECT)),
        "locality": _formed(place_only, LOCALITY_FORMS),
        "territory": _pick(seg, lambda s: s.rlike(TERRITORY)),
        "microdistrict": _pick(seg, lambda s: s.rlike(MICRODISTRICT)),
        "street": street,
        "house": house_display(base, mods, F.col("house_kind")),
        "premise": _pick(seg, lambda s: s.rlike(ROOM)),
        "house_base": F.when(base != "", base),
        "house_mods": F.when(mods != "", mods),
        "house_modifiers": modifiers_list(mods),
        "street_numbers": F.col("parsed.sn"),
    }
    once = once.select("_raw", "parsed", F.struct(*[v.alias(k) for k, v in slots.items()]).alias("slots"))
    return df.join(once, df[raw].eqNullSafe(once["_raw"]), "left").drop("_raw")


def line_of(slots: Column, with_subject: bool = False, enabled: tuple[str, ...] = LINE_SLOTS) -> Column:
    """The line of a card, each different level once."""
    skipped = () if with_subject else ("federal_district", "parent_subject", "subject", "autonomous_okrug")
    return construct_address([slots[s] for s in LINE_SLOTS if s in enabled and s not in skipped and s != "postal_index"])


def slot_order(order: str | list[str] | dict[str, int] | None, selected: list[str] | None = None) -> list[str]:
    """Slots in the wanted order: a list, names with commas, or positions by name; the rest follows in the usual order."""
    usual = [s for s in (*LINE_SLOTS, *TECHNICAL_SLOTS) if (selected is None and s not in DEFAULT_OFF) or (selected is not None and s in selected)]
    if isinstance(order, str):
        order = [s.strip() for s in order.split(",")]
    if isinstance(order, dict):
        order = sorted(order, key=lambda s: order[s])
    first = [s for s in order or [] if s in usual]
    return [*dict.fromkeys(first), *[s for s in usual if s not in first]]


def deconstructed(df: DataFrame, raw: str, order: list[str] | None = None, keep_source: bool = True) -> DataFrame:
    """df with a column for each slot in order, optionally without the source column."""
    wide = with_slots(df, raw)
    names = [s for s in slot_order(order) if s in LINE_SLOTS or s in ("house_base", "house_mods")]
    return wide.select(*[c for c in df.columns if keep_source or c != raw], *[F.col(f"slots.{s}").alias(s) for s in names])


def territory_key(code: Column, locality: Column, fallback: Column) -> Column:
    """`oktmo:` and the code, else the locality, else the parsed territory."""
    return F.coalesce(F.when(code != "", F.concat(F.lit("oktmo:"), code)), F.when(level_key(locality) != "", level_key(locality)), fallback)


def normalized_addresses(df: DataFrame, raw: str, registry: DataFrame | None = None, city: str = "") -> DataFrame:
    """df with slots, normalized (the line), oktmo_code, municipality, territory_key, strict_key, relaxed_key, match_key.

    registry: code and name. A locality is looked up by name; its district gives the municipality.
    """
    out = with_slots(df, raw, city)
    if registry is not None:
        from plumbline.operators import registry as R

        found = R.lookup_names(out.select(F.col("slots.locality").alias("name")).where("name is not null"), R.name_index(registry))
        codes = found.join(registry.select(level_key("name").alias("key"), "code").groupBy("key").agg(F.max_by("code", F.struct(F.length("code"), F.col("code"))).alias("oktmo_code")), "key").select(F.col("name").alias("_place"), "oktmo_code")
        codes = R.municipalities(codes.withColumnRenamed("oktmo_code", "code"), registry).withColumnsRenamed({"code": "oktmo_code", "municipality": "_m"})
        out = out.join(codes, F.col("slots.locality") == F.col("_place"), "left").drop("_place")
    else:
        out = out.withColumns({"oktmo_code": F.lit(None).cast("string"), "_m": F.lit(None).cast("string")})
    municipality = F.coalesce("slots.municipality", "_m")
    out = out.withColumn("municipality", municipality).withColumn("slots", F.col("slots").withField("municipality", F.col("municipality")))
    key = territory_key(F.coalesce("oktmo_code", F.lit("")), F.col("slots.locality"), F.col("parsed.ter"))
    numbers = F.array_join("parsed.sn", " ")
    return out.withColumn("territory_key", key).withColumns(
        {
            "normalized": line_of(F.col("slots")),
            "strict_key": F.concat_ws("|", "territory_key", "parsed.sw", numbers, "parsed.hb", "parsed.hm"),
            "relaxed_key": F.concat_ws("|", "territory_key", "parsed.sw", numbers, "parsed.hb"),
            "match_key": F.concat_ws("|", "parsed.sw", numbers, "parsed.hb", "parsed.hm"),
        }
    ).drop("_m")


def guarded(df: DataFrame, raw: str, city: str = "") -> DataFrame:
    """df with output and kept_original: the normalized line, unless a street or a house would be lost or changed by it."""
    first = normalized_addresses(df, raw, None, city).withColumnRenamed("parsed", "_before")
    again = A.parsed(first, "normalized", city)
    same = (F.col("_before.sw") == F.col("parsed.sw")) & (F.col("_before.hb") == F.col("parsed.hb")) & (F.col("_before.hm") == F.col("parsed.hm"))
    core = (F.col("_before.sw") != "") & (F.col("_before.hb") != "")
    keep = ~(same & core & (F.col("normalized") != ""))
    return again.select(*df.columns, F.when(keep, F.col(raw)).otherwise(F.col("normalized")).alias("output"), keep.alias("kept_original"))


#: How an official place name is written in an address, by its first words.
OFFICIAL_FORMS = (("г. ", "город|г"), ("с. ", "село|с"), ("д. ", "деревня|д"), ("пгт ", "пос[её]лок\\s+городского\\s+типа|пгт"), ("р. п. ", "рп|р\\.?\\s*п"), ("п. ", "пос[её]лок|п"), ("пос. ", "пос"), ("х. ", "хутор|х"), ("ст-ца ", "станица"), ("ст. ", "станция|ст"))


def official_locality(name: Column) -> Column:
    """An official place name as addresses write it; null for what is no place of its own."""
    text = clean(name)
    out = text
    for to, spellings in reversed(OFFICIAL_FORMS):
        pattern = f"(?iuU)^(?:{spellings})\\.?\\s+"
        out = F.when(text.rlike(pattern), F.regexp_replace(text, pattern, to)).otherwise(out)
    return F.when(~(text.rlike(SUBJECT) | text.rlike(MUNICIPALITY)), out)


def locality_key(name: Column) -> Column:
    """Letters of a place name without its kind."""
    return F.regexp_replace(level_key(F.regexp_replace(normalized(name), "^р п ", "рп ")), " ", "")


def official_if_same(locality: Column, official: Column) -> Column:
    """The official name if it is the same place."""
    return F.when(locality_key(locality) == locality_key(official), official)


def renormalized(slot: str, value: Column) -> Column:
    """A slot's value in the form in which votes compare it."""
    text = clean_once(value) if slot in ("street", "house") else clean(value)
    if slot == "street":
        return street_display(text)
    if slot == "house":
        base = lambda t: F.regexp_extract(F.lower(t), "^(?:дом|д|здание|зд|строение|стр)?\\.?\\s*([0-9]+)", 1)
        tail = lambda t: F.regexp_extract(F.lower(t), "^(?:дом|д|здание|зд|строение|стр)?\\.?\\s*[0-9]+(.*)$", 1)
        return let(text, lambda t: let(A.house_modifiers(tail(t)), lambda mods: let(base(t), lambda b: house_display(b, mods, house_kind(t)))))
    if slot == "locality":
        return official_locality(text)
    if slot == "municipality":
        return F.regexp_replace(F.regexp_replace(text, f"(?iuU)\\bр-н{A.R}\\.?", "район"), f"(?iuU)\\bг\\.?\\s*о\\.(?!\\p{{L}})", "городской округ")
    if slot == "microdistrict":
        return F.regexp_replace(text, f"(?iuU)^(?:микрорайон|мкр){A.R}\\.?\\s*", "мкр. ")
    return text


def projected(df: DataFrame, order: list[str] | str | None = None, selected: list[str] | None = None, keep_unknown: bool = False) -> DataFrame:
    """The slot columns that df has, in the wanted order; other columns behind them, if they are to be kept."""
    slots = [s for s in slot_order(order, selected) if s in df.columns]
    known = {*LINE_SLOTS, *TECHNICAL_SLOTS}
    return df.select(*slots, *[c for c in df.columns if keep_unknown and c not in known])
