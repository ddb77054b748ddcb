"""Regions and their federal districts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regions by federal district.
DISTRICTS = {
    "Центральный": "Белгородская область, Брянская область, Владимирская область, Воронежская область, Ивановская область, Калужская область, Костромская область, Курская область, Липецкая область, Московская область, Орловская область, Рязанская область, Смоленская область, Тамбовская область, Тверская область, Тульская область, Ярославская область, Москва",
    "Северо-Западный": "Республика Карелия, Республика Коми, Архангельская область, Вологодская область, Калининградская область, Ленинградская область, Мурманская область, Новгородская область, Псковская область, Санкт-Петербург, Ненецкий автономный округ",
    "Южный": "Республика Адыгея, Республика Калмыкия, Республика Крым, Краснодарский край, Астраханская область, Волгоградская область, Ростовская область, Севастополь",
    "Северо-Кавказский": "Республика Дагестан, Республика Ингушетия, Кабардино-Балкарская Республика, Карачаево-Черкесская Республика, Республика Северная Осетия - Алания, Чеченская Республика, Ставропольский край",
    "Приволжский": "Республика Башкортостан, Республика Марий Эл, Республика Мордовия, Республика Татарстан, Удмуртская Республика, Чувашская Республика, Пермский край, Кировская область, Нижегородская область, Оренбургская область, Пензенская область, Самарская область, Саратовская область, Ульяновская область",
    "Уральский": "Курганская область, Свердловская область, Тюменская область, Челябинская область, Ханты-Мансийский автономный округ - Югра, Ямало-Ненецкий автономный округ",
    "Сибирский": "Республика Алтай, Республика Тыва, Республика Хакасия, Алтайский край, Красноярский край, Иркутская область, Кемеровская область, Новосибирская область, Омская область, Томская область",
    "Дальневосточный": "Республика Бурятия, Республика Саха (Якутия), Забайкальский край, Камчатский край, Приморский край, Хабаровский край, Амурская область, Магаданская область, Сахалинская область, Еврейская автономная область, Чукотский автономный округ",
}


def default_regions(spark: SparkSession) -> DataFrame:
    """region_id (in order), name, federal_district."""
    rows = [(name, f"{district} федеральный округ") for district, names in DISTRICTS.items() for name in names.split(", ")]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "region_id int, name string, federal_district string")


def with_districts(regions: DataFrame) -> DataFrame:
    """regions (region_id, name, federal_district): a blank district filled from the defaults by name."""
    from plumbline.functions.text import clean, region_key

    known = default_regions(regions.sparkSession).select(region_key("name").alias("_k"), F.col("federal_district").alias("_d")).dropDuplicates(["_k"])
    joined = regions.withColumn("_k", region_key("name")).join(F.broadcast(known), "_k", "left")  # a fixed table
    return joined.withColumn("federal_district", F.coalesce(clean("federal_district"), "_d")).select(*regions.columns)
