"""Text expressions: Column in, Column out. All stay inside Catalyst."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type words that a building key leaves out, longest first.
KEY_WORDS = ("город", "г", "улица", "ул", "переулок", "пер", "пр-кт", "проспект", "дом", "д", "корпус", "корп", "строение", "стр")
#: Words before the number of a room or flat, longest first.
ROOM_WORDS = ("квартира", "кв", "комната", "ком", "kom", "помещение", "пом")
#: Settlement type words that a level comparison leaves out.
LEVEL_WORDS = ("город", "г", "поселок", "пос", "п", "деревня", "д", "село", "с", "станица", "ст", "хутор", "х", "рп", "пгт")
#: Adjective endings, genitive to nominative, for region names.
REGION_ENDINGS = (("ского", "ский"), ("цкого", "цкий"), ("ской", "ская"), ("цкой", "цкая"), ("ного", "ный"), ("ной", "ная"))

#: A place before which no letter or digit stands, for engines whose \b knows ASCII only.
EDGE = "(^|[^0-9a-zа-я])"
KEY_PATTERN = f"{EDGE}({'|'.join(KEY_WORDS)})"
ROOM_PATTERN = f"{EDGE}({'|'.join(ROOM_WORDS)})[. №-]*[0-9]+.*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """What body makes of a value that is worked out once, however often body names it: an expression in a lambda or behind a condition is not shared."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean(value: Column | str) -> Column:
    """One blank for any white space, ends without blanks and commas; blank and `nan` are null."""
    return _given(_squeezed(value))


def clean_once(value: Column | str) -> Column:
    """clean() where expressions are not shared: white space is looked for once, not once for each question about what is left."""
    return let(_squeezed(value), _given)


def _squeezed(value: Column | str) -> Column:
    return F.btrim(F.regexp_replace(_col(value), "(?U)\\s+", " "), F.lit(" ,"))


def _given(text: Column) -> Column:
    return F.when((text != "") & (F.lower(text) != "nan"), text)


def normalized(value: Column | str) -> Column:
    """Lower case, ё as е, anything but letters and digits as one blank; never null."""
    low = F.replace(F.lower(F.coalesce(_col(value), F.lit(""))), F.lit("ё"), F.lit("е"))
    return F.btrim(F.regexp_replace(low, "[^0-9a-zа-я]+", " "))


def level_key(value: Column | str) -> Column:
    """normalized() without settlement type words."""
    words = F.split(normalized(value), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*LEVEL_WORDS)), " ")


#: Kinds of municipalities and places that a comparison of places leaves out, longest first.
GEO_WORDS = ("муниципальное образование", "городской округ", "муниципальный округ", "муниципальный район", "городское поселение", "сельское поселение", "поселок городского типа", "рабочий поселок", "город", "село", "деревня", "поселок", "район", "округ", "пгт", "рп", "г", "с", "д", "п")


#: Kinds of places, territories and streets that a registry's name keys leave out; those of several words first.
REGISTRY_PHRASES = ("ж д станция", "ж д разъезд", "ж д ст", "ж д рзд", "поселок городского типа", "поселок при станции", "поселок станции", "рабочий поселок", "городской поселок", "курортный поселок", "дачный поселок", "населенный пункт", "п г т", "п ст", "г п", "р п", "к п", "д п", "н п")
REGISTRY_WORDS = ("гп", "дп", "кп", "г", "гор", "город", "район", "обл", "область", "кр", "край", "мо", "мун", "округ", "ао", "мкр", "пгт", "рп", "пос", "поселок", "с", "село", "д", "деревня", "ст", "станица", "х", "хутор", "рзд", "разъезд", "аул", "аал", "арбан", "улус", "у", "нп", "н", "п", "м", "местечко", "кишлак", "к", "ул")
#: The same kinds where they are written with a dash.
REGISTRY_DASHED = ("р н", "ст ца", "пр т", "пр кт", "пр д")


def without_phrases(text: Column, phrases: tuple[str, ...]) -> Column:
    """A normalized text without these whole words and phrases, in their order."""
    out = F.concat(F.lit(" "), F.regexp_replace(text, " ", "  "), F.lit(" "))
    for words in phrases:
        out = F.replace(out, F.lit(f" {words.replace(' ', '  ')} "), F.lit(" "))
    return F.btrim(F.regexp_replace(out, " +", " "))


def geo_key(value: Column | str) -> Column:
    """normalized() without kinds of municipalities and places."""
    return without_phrases(normalized(value), GEO_WORDS)


def registry_key(value: Column | str) -> Column:
    """What a registry's name is looked up by: normalized() without kinds of places, stations and territories."""
    return without_phrases(normalized(value), (*REGISTRY_PHRASES, *REGISTRY_DASHED, *REGISTRY_WORDS))


def named_words(value: Column | str) -> Column:
    """Words longer than a letter, and numbers, sorted."""
    low = F.translate(F.lower(F.coalesce(_col(value), F.lit(""))), "ё\"'«»“”‘’", "е")
    words = F.split(F.btrim(F.regexp_replace(low, "(?U)[^\\w]+", " ")), " ")
    return F.array_join(F.array_sort(F.filter(words, lambda w: (F.length(w) > 1) | w.rlike("^[0-9]$"))), " ")


def region_key(value: Column | str) -> Column:
    """normalized() with adjectives in the nominative and without type words."""

    def word(w: Column) -> Column:
        out = w
        for ending, to in reversed(REGION_ENDINGS):
            out = F.when(w.endswith(ending), F.concat(F.left(w, F.length(w) - len(ending)), F.lit(to))).otherwise(out)
        return out

    words = F.filter(F.split(normalized(value), " "), lambda w: ~w.isin("область", "области", "край", "края", "республика", "республики", "округ", "округа", "автономный", "автономного", "ао", "обл", "респ", "город", "г"))
    return F.array_join(F.transform(words, word), " ")


def postal_index(value: Column | str) -> Column:
    found = F.regexp_extract(_col(value), "(?<![0-9])([1-6][0-9]{5})(?![0-9])", 1)
    return F.when(found != "", found)


def building_key(*parts: Column | str) -> Column:
    """Key of a building from the parts of its address: rooms and type words go, the rest is normalized.

    A type word goes even where it only begins a longer word, on both sides of a comparison alike.
    """
    kept = [F.when(F.btrim(_col(p)) != "", F.btrim(_col(p))) for p in parts]
    low = F.translate(F.lower(F.concat_ws(" ", *kept)), "ё", "е")
    no_room = F.regexp_replace(low, ROOM_PATTERN, "$1")
    # twice, so that a word right behind another one is met too
    no_type = reduce(lambda c, _: F.regexp_replace(c, KEY_PATTERN, "$1 "), range(2), no_room)
    return F.btrim(F.regexp_replace(no_type, "[^0-9a-zа-я]+", " "))


def natural_key(value: Column | str, width: int = 12) -> Column:
    """An array that sorts digit runs as numbers, before letters; blank texts sort last."""
    runs = F.regexp_extract_all(normalized(value), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    tagged = F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(r, width, "0"))).otherwise(F.concat(F.lit("1"), F.btrim(r))))
    return F.when(normalized(value) == "", F.array(F.lit("2"))).otherwise(tagged)


def word_jaccard(left: Column, right: Column) -> Column:
    """100 times shared words over all words of two normalized texts."""
    a, b = F.array_distinct(F.split(left, " ")), F.array_distinct(F.split(right, " "))
    return 100.0 * F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def _edit_ratio(a: Column, b: Column) -> Column:
    """100 times twice the longest common subsequence over both lengths."""
    letters = F.split(b, "")

    def row(before: Column, x: Column) -> Column:
        def step(made: Column, y_at: Column) -> Column:
            y, i = y_at["y"], y_at["i"]
            best = F.when(x == y, F.get(before, i) + 1).otherwise(F.greatest(F.get(before, i + 1), F.element_at(made, -1)))
            return F.concat(made, F.array(best))

        places = F.transform(letters, lambda y, i: F.struct(y.alias("y"), i.alias("i")))
        return F.aggregate(places, F.array(F.lit(0)), step)

    start = F.array_repeat(F.lit(0), F.length(b) + 1)
    common = F.element_at(F.aggregate(F.split(a, ""), start, row), -1)
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(200.0 * common / total)


def token_set_ratio(left: Column, right: Column) -> Column:
    """Best edit ratio among the shared words and each side's words put after them. For blocked pairs only."""
    a, b = F.array_sort(F.array_distinct(F.split(left, " "))), F.array_sort(F.array_distinct(F.split(right, " ")))
    shared = F.array_join(F.array_intersect(a, b), " ")
    full_a = F.btrim(F.concat_ws(" ", shared, F.array_join(F.array_except(a, b), " ")))
    full_b = F.btrim(F.concat_ws(" ", shared, F.array_join(F.array_except(b, a), " ")))
    whole = (shared != "") & ((shared == full_a) | (shared == full_b))
    return F.when(whole, 100.0).otherwise(F.greatest(_edit_ratio(full_a, full_b), F.when(shared != "", F.greatest(_edit_ratio(shared, full_a), _edit_ratio(shared, full_b))).otherwise(0.0)))


def column_index(letters: Column | str) -> Column:
    """Sheet column letters to a number from 1."""
    codes = F.transform(F.split(F.upper(_col(letters)), ""), lambda x: F.ascii(x) - 64)
    return F.aggregate(codes, F.lit(0), lambda acc, x: acc * 26 + x)


def locator_row(locator: Column | str) -> Column:
    """Row of `Sheet!B7`, `L3:C2` or `P4`; null if there is none."""
    found = F.regexp_extract(_col(locator), "(?:![A-Z]*|^[LTP])([0-9]+)", 1)
    return F.when(found != "", found.cast("int"))


def without_tail(value: Column | str) -> Column:
    """Cuts cadastral numbers, phones, mails and links off the end."""
    return clean(F.regexp_replace(_col(value), r"(?iu)[\s,;(]*(?:\d{2}:\d{2}:\d{6,7}:\d+|кадастр\S*|тел\.?\s*[:+\d]|\+7|e-?mail|https?:|www\.|\S+@\S+).*$", ""))
