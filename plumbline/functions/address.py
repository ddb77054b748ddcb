"""Address parsing as staged column expressions.

parsed(df, column) gives each row the struct
(ter, sw, sn, hb, hm): territory, sorted street words, street numbers, house number, house
modifiers. Distinct strings are parsed once and joined back by default, since real tables repeat
their addresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import let

#: Words for kinds of streets, settlements, territories and rooms.
STREET_TYPES = ("улица", "ул", "переулок", "пер", "пр-кт", "пр-т", "прт", "проспект", "просп", "пр-д", "проезд", "пр", "бульвар", "б-р", "бульв", "тракт", "шоссе", "ш", "тупик", "туп", "аллея", "линия", "набережная", "наб", "площадь", "пл", "квартал", "кв-л", "микрорайон", "мкр", "проул", "км", "автодорога")
SETTLEMENT_TYPES = ("городской поселок", "рабочий поселок", "курортный поселок", "дачный поселок", "поселок городского типа", "поселок при станции", "поселок станции", "населенный пункт", "город", "поселок", "пос", "деревня", "село", "слобода", "сл", "станица", "станция", "хутор", "аул", "разъезд", "улус", "местечко", "кишлак", "аал", "арбан", "починок", "выселок", "выселки", "заимка", "кордон", "маяк", "погост", "слободка", "усадьба", "лесоучасток", "метеостанция")
SHORT_SETTLEMENTS = ("г", "п", "д", "с", "х", "рп", "пгт", "нп", "кп", "дп", "ст")
TERRITORIES = ("снт", "сосн", "днт", "тсн", "остров")
ADMIN_WORDS = ("область", "обл", "край", "район", "р-н", "округ", "республика", "респ")
ROOMS = ("помещение", "помещ", "пом", "квартира", "кв", "офис", "оф", "комната", "ком")
OBJECTS = ("школа", "сош", "оош", "лицей", "гимназия", "садик", "доу", "колледж", "техникум", "университет", "академия", "институт", "мбоу", "мбдоу", "маоу", "филиал")
ORDINALS = ("я", "й", "го", "ой", "ая", "ий", "ых", "ому")
#: Misspelt street words.
WORD_REPAIRS = {"совесткая": "советская", "советска": "советская", "совсетов": "советов", "украинска": "украинская"}


def _any(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(sorted((w.replace(" ", "\\s+") for w in words), key=len, reverse=True)) + ")"


L, R = "(?iuU)(?<![0-9a-zа-я])", "(?![0-9a-zа-я])"
STREET = f"{L}{_any(STREET_TYPES)}{R}\\.?"
RAIL = "(?:п\\.?\\s*)?ж\\s*[./-]?\\s*-?\\s*д\\.?\\s*(?:остановочн\\w*\\s+пункт|блокпост|будка|ветка|казарма|платформа|площадка|путевой\\s+пост|ст\\.?|рзд\\.?|станция|разъезд)"
SPLIT_TYPES = "(?:ст\\s*[.-]?\\s*ца\\.?(?=\\s)|[рпкдгн]\\.\\s*п\\.|р\\.?п\\.?|п\\.?г\\.?т\\.?)"
SETTLEMENT = f"(?:{RAIL}|{SPLIT_TYPES}|{_any(SETTLEMENT_TYPES)}{R}|{_any(SHORT_SETTLEMENTS)}(?:\\.|(?=\\s)))"
_UNIT = "[0-9]+(?:[а-яa-z](?![0-9а-яa-z]))?"
BLOCK = f"(?:корпус|корп|кор|к)\\.?\\s*{_UNIT}"
BUILDING = f"(?:строение|стр|с)\\.?\\s*{_UNIT}"
LETTER = "(?:литера|лит)\\.?\\s*[а-яa-z](?![0-9а-яa-z])"
TAIL = f"(?:\\s*[,;]?\\s*(?:{BLOCK}|{BUILDING}|{LETTER})|\\s*[/-]\\s*{_UNIT}|\\s*[/-]?\\s*[а-яa-z](?![0-9а-яa-z]))*"
ROOM_TAIL = f"\\s*[,;]?\\s*{_any(ROOMS)}{R}.*$"


def prepared(raw: Column) -> Column:
    """Lower case, no quotes, single blanks, no postal index."""
    low = F.translate(F.lower(F.coalesce(raw, F.lit(""))), "ё \"'«»“”‘’", "е ")
    low = F.regexp_replace(low, "(?<![0-9])[0-9]{6}(?![0-9])", " ")
    for wrong, right in WORD_REPAIRS.items():
        low = F.regexp_replace(low, f"{L}{wrong}{R}", right)
    return F.btrim(F.regexp_replace(low, "\\s+", " "), F.lit(" ,;"))


#: Words before a number or letter that make it a modifier, with the mark and rank that it gets.
MODIFIER_MARKS = (("1к", ("корпус", "корп", "кор", "к", "/", "-")), ("2с", ("строение", "стр", "с")))
LETTER_MARKS = ("литера", "лит")


def house_modifiers(tail: Column) -> Column:
    """Canonical modifiers: plain letters, then к, с, лит, each sorted.

    The tail is taken as tokens. A number counts by the word or sign before it; a letter counts as
    a literal after `лит`, and as itself unless it is the word for the number behind it.
    """
    words = [w for _, ws in MODIFIER_MARKS for w in ws if len(w) > 1] + list(LETTER_MARKS)
    token = f"[0-9]+(?:[а-яa-z](?![0-9а-яa-z]))?|{_any(tuple(words))}|[а-яa-z/-]"
    tokens = F.regexp_extract_all(F.lower(tail), F.lit(token), F.lit(0))

    def modifier(ts: Column, t: Column, i: Column) -> Column:
        before, after = F.when(i > 0, F.get(ts, i - 1)), F.get(ts, i + 1)
        out = F.when(t.rlike("^[а-яa-z]$") & before.isin(*LETTER_MARKS), F.concat(F.lit("3лит"), t))
        for mark, ws in MODIFIER_MARKS:
            out = out.when(t.rlike("^[0-9]") & before.isin(*ws), F.concat(F.lit(mark), t))
        stands_for_number = t.isin("к", "с") & F.coalesce(after.rlike("^[0-9]"), F.lit(False))
        return out.when(t.rlike("^[а-яa-z]$") & ~stands_for_number, F.concat(F.lit("0"), t))

    found = let(tokens, lambda ts: F.transform(ts, lambda t, i: modifier(ts, t, i)))
    return F.array_join(F.transform(F.array_sort(F.array_compact(found)), lambda t: F.substring(t, 2, 100)), "")


def _ends_with_street_type(text: Column) -> Column:
    """The last word, with no comma behind it, is a street's type, or `имени` behind one, so that a number next is part of the name."""
    words = F.filter(F.split(F.regexp_replace(F.element_at(F.split(text, ","), -1), "[^0-9a-zа-я-]+", " "), " "), lambda w: w != "")
    nth = lambda k: F.when(F.size(words) >= k, F.element_at(words, -k))
    return F.coalesce(nth(1).isin(*STREET_TYPES) | (nth(1).isin("имени", "им") & nth(2).isin(*STREET_TYPES)), F.lit(False))


def _stage(df: DataFrame, raw: str) -> DataFrame:
    """df with _loc, _hb, _hm, _kind: the text before or behind the house, its number, modifiers and kind (д, зд, стр)."""
    text = df.withColumn("_t", prepared(F.col(raw)))
    marked = lambda words: f"(?iuU)^(.*?)(?<![-а-яa-z])({words})\\.?\\s*([0-9]+)({TAIL})\\s*(?:[,;(].*)?$"
    patterns = {
        # a house before a room, with a street or a word before it
        "_room": (f"(?iuU)^(.*?[а-яa-z].*?)[\\s,;]+(д\\.?\\s*|дом\\s+)?([0-9]+)({TAIL}){ROOM_TAIL}", (1, 3, 4, 2)),
        "_named": (marked("дом|д|здание|зд"), (1, 3, 4, 2)),
        "_built": (marked("строение|стр"), (1, 3, 4, 2)),
        "_last": (f"(?iuU)^(.*?[а-яa-z].*?)(?<![0-9/-])([0-9]+)({TAIL})$", (1, 2, 3, 0)),
        "_front": (f"(?iuU)^()([0-9]+)({TAIL})\\s*[,;]\\s*(?={_any(STREET_TYPES)}(?![0-9a-zа-я]))", (1, 2, 3, 0)),
    }
    for name, (p, groups) in patterns.items():
        fields = [F.regexp_extract("_t", p, k).alias(x) if k else F.lit("").alias(x) for k, x in zip(groups, ("before", "hb", "tail", "mark"), strict=True)]
        text = text.withColumn(name, F.when(F.col("_t").rlike(p), F.struct(*fields)))
    guarded = F.when(~_ends_with_street_type(F.col("_last.before")) | ~F.col("_last.tail").rlike("[а-яa-z]{2,}"), F.col("_last"))
    # a building's number is the house, unless a house stands before it
    built = F.when(F.col("_last").isNull() | (F.length("_last.before") >= F.length("_built.before")), F.col("_built"))
    text = text.withColumn("_house", F.coalesce("_room", "_named", built, "_front", guarded))
    in_front = F.col("_front").isNotNull() & F.coalesce("_room", "_named", built).isNull()
    rest = F.when(in_front, F.regexp_replace("_t", f"(?iuU)^[0-9]+{TAIL}\\s*[,;]\\s*", "")).otherwise(F.coalesce("_house.before", "_t"))
    kind = F.when(F.col("_house.mark").startswith("зд"), "зд").when(F.col("_house.mark").startswith("ст"), "стр").otherwise("д")
    return text.withColumns({"_loc": F.btrim(rest, F.lit(" ,;")), "_hb": F.coalesce("_house.hb", F.lit("")), "_hm": F.coalesce(house_modifiers(F.col("_house.tail")), F.lit("")), "_kind": kind})


def _places(df: DataFrame, city: str) -> DataFrame:
    segments = F.filter(F.transform(F.split("_loc", ","), lambda s: F.btrim(s)), lambda s: s != "")
    admin = f"{L}{_any(ADMIN_WORDS)}{R}"
    settlement = f"(?iuU)^\\s*{SETTLEMENT}\\s*([а-яa-z0-9][а-яa-z0-9 -]*?)(?=\\s+{STREET}|\\s*$)"
    is_city = f"(?iuU)^(?:город|г)\\.?\\s+[а-яa-z -]+$"
    df = df.withColumn("_seg", F.filter(segments, lambda s: ~s.rlike(admin)))
    named = F.filter(F.transform("_seg", lambda s: F.when(~s.rlike(is_city), F.regexp_extract(s, settlement, 1)).otherwise("")), lambda x: x != "")
    plots = F.filter(F.transform("_seg", lambda s: F.regexp_extract(s, f"{L}{_any(TERRITORIES)}\\s+([а-яa-z0-9][а-яa-z0-9 -]*)$", 1)), lambda x: x != "")
    df = df.withColumn("_ter", F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(F.concat_ws(" ", F.element_at(F.concat(F.array(F.lit("")), named), -1), F.array_join(plots, " ")), "[^0-9a-zа-я]+", " "), " "), lambda w: (F.length(w) > 1) | w.rlike("^[0-9]$")))))
    # a city repeated, without a comma, before a street whose type comes last
    bare = F.transform("_seg", lambda s: F.regexp_replace(s, f"(?iuU)^\\s*(?:город|г)\\.?\\s+[а-яa-z-]+\\s+(?=\\S+\\s+{_any(STREET_TYPES)}\\.?$)", " "))
    bare = F.transform(bare, lambda s: F.regexp_replace(s, f"(?iuU)^\\s*{SETTLEMENT}\\s*[а-яa-z0-9][а-яa-z0-9 -]*?(?=\\s+{STREET}|\\s*$)", " "))
    bare = F.transform(bare, lambda s: F.regexp_replace(s, f"{L}{_any(TERRITORIES)}\\s+[а-яa-z0-9 -]*$", " "))
    street = F.array_join(bare, " ")
    for p in (STREET, f"{L}{_any(OBJECTS)}{R}\\s*(?:№\\s*)?[0-9]*", f"{L}(?:имени|им\\.?|тер\\.?|территория|участок|уч\\.?|город|г){R}\\.?", f"{L}{_any(ROOMS)}{R}\\.?"):
        street = F.regexp_replace(street, p, " ")
    street = F.regexp_replace(street, f"(?<![0-9])([0-9]+)\\s*-?\\s*{_any(ORDINALS)}{R}", "$1")
    words = F.split(F.btrim(F.regexp_replace(street, "[^0-9a-zа-я]+", " ")), " ")
    if city:
        words = F.filter(words, lambda w: w != city)
    # a street that has no name but its number keeps its type as one
    numbered = F.element_at(F.concat(F.array(F.lit("")), F.transform("_seg", lambda s: F.regexp_extract(s, f"(?iuU)^[0-9]+\\s*-?\\s*{_any(ORDINALS)}\\s+({_any(STREET_TYPES)})\\.?$", 1))), -1)
    nameless = ~F.exists(words, lambda w: (F.length(w) > 1) & ~w.rlike("^[0-9]+$")) & (numbered != "")
    return df.withColumn("_w", F.when(nameless, F.concat(words, F.array(numbered))).otherwise(words))


def parse_distinct(df: DataFrame, raw: str, city: str = "", kind: bool = False) -> DataFrame:
    """df with the struct `parsed`; raw may be null, which parses to blanks. With kind also house_kind: д, зд or стр."""
    out = _places(_stage(df, raw), city)
    parsed = F.struct(
        F.array_join("_ter", " ").alias("ter"),
        F.array_join(F.array_sort(F.filter("_w", lambda w: (F.length(w) > 1) & ~w.rlike("^[0-9]+$"))), " ").alias("sw"),
        F.array_sort(F.array_distinct(F.filter("_w", lambda w: w.rlike("^[0-9]+$")))).alias("sn"),
        F.col("_hb").alias("hb"),
        F.col("_hm").alias("hm"),
    )
    return out.withColumn("parsed", parsed).select(*df.columns, "parsed", *([F.col("_kind").alias("house_kind")] if kind else []))


def parsed(df: DataFrame, raw: str, city: str = "", kind: bool = False) -> DataFrame:
    """As parse_distinct(), but each different string is parsed once."""
    once = parse_distinct(df.select(F.col(raw).alias("_raw")).distinct(), "_raw", city, kind)
    return df.join(once, df[raw].eqNullSafe(once["_raw"]), "left").drop("_raw")


def same_house(hb1: Column, hm1: Column, hb2: Column, hm2: Column) -> Column:
    """Both without a house, or the same house with the same modifiers."""
    return ((hb1 == "") & (hb2 == "")) | ((hb1 != "") & (hb1 == hb2) & (hm1 == hm2))


def rendered(parsed_: Column, city: Column) -> Column:
    """A one-line address from a parsed struct and a city."""
    parts = F.array(F.when(city != "", F.concat(F.lit("г. "), F.initcap(city))), F.when(parsed_["sw"] != "", F.concat(F.lit("ул. "), F.initcap(parsed_["sw"]))), F.when(parsed_["hb"] != "", F.concat(F.lit("д. "), parsed_["hb"])), F.when(parsed_["hm"].rlike("^к[0-9]"), F.concat(F.lit("к. "), F.regexp_extract(parsed_["hm"], "^к([0-9]+)", 1))))
    return F.array_join(F.array_compact(parts), ", ")
