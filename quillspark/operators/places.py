"""Places: the city and the kind of place that a question names, the map query for them, and the rows of a map's answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Cities with latitude and longitude; keywords of a category with its map filter, in order of precedence.
CITIES = [
    ("تهران", 35.6892, 51.3890),
    ("مشهد", 36.2605, 59.6168),
    ("اصفهان", 32.6546, 51.6680),
    ("کرج", 35.8400, 50.9391),
    ("شیراز", 29.5918, 52.5837),
    ("تبریز", 38.0962, 46.2738),
    ("قم", 34.6399, 50.8759),
    ("اهواز", 31.3183, 48.6706),
    ("کرمانشاه", 34.3142, 47.0650),
    ("ارومیه", 37.5494, 45.0689),
    ("کرمان", 30.2852, 57.0648),
    ("یزد", 31.8974, 54.3569),
    ("رشت", 37.2808, 49.5832),
    ("زاهدان", 29.4963, 60.8629),
    ("همدان", 34.7983, 48.5148),
    ("بندرعباس", 27.1832, 56.2666),
    ("اراک", 34.0917, 49.6892),
    ("قزوین", 36.2688, 50.0041),
    ("زنجان", 36.6769, 48.4850),
    ("گرگان", 36.8417, 54.4348),
    ("ساری", 36.5659, 53.0586),
]
CATEGORIES = [
    (["رستوران", "restaurant"], '["amenity"="restaurant"]'),
    (["فست‌فود", "فست فود", "fastfood", "fast food"], '["amenity"="fast_food"]'),
    (["کافه", "کافی", "قهوه", "coffee", "cafe"], '["amenity"="cafe"]'),
    (["هتل", "hotel", "مسافرخانه"], '["tourism"="hotel"]'),
    (["بیمارستان", "hospital"], '["amenity"="hospital"]'),
    (["داروخانه", "pharmacy"], '["amenity"="pharmacy"]'),
    (["آرایشگاه", "hairdresser", "salon", "آرایش"], '["shop"="hairdresser"]'),
    (["بانک", "bank", "عابربانک"], '["amenity"="bank"]'),
    (["پمپ بنزین", "بنزین", "fuel"], '["amenity"="fuel"]'),
    (["نانوایی", "bakery"], '["shop"="bakery"]'),
    (["سوپرمارکت", "supermarket", "فروشگاه", "مغازه"], '["shop"~"supermarket|convenience|mall|department_store"]'),
    (["پارک", "park", "بوستان"], '["leisure"="park"]'),
    (["موزه", "museum"], '["tourism"="museum"]'),
    (["سینما", "cinema", "تئاتر"], '["amenity"="cinema"]'),
    (["مدرسه", "school"], '["amenity"="school"]'),
    (["دانشگاه", "university"], '["amenity"="university"]'),
    (["مسجد", "mosque"], '["amenity"="place_of_worship"]["religion"="muslim"]'),
    (["باشگاه", "gym", "fitness"], '["leisure"="fitness_centre"]'),
]
NAME_WORD = r"[\p{L}\p{N}_\x{600}-\x{6FF}]{3,}"
RADIUS_M, FAR_RADIUS_M = 30_000, 60_000
ADDRESS_PARTS = ("addr:housenumber", "addr:road", "addr:suburb", "addr:city")


def _first_match(options: list[tuple[Column, Column]]) -> Column:
    """The value of the first condition that holds, else null."""
    out = F.lit(None)
    for condition, value in reversed(options):
        out = F.when(condition, value).otherwise(out)
    return out


def city(question: Column) -> Column:
    """A struct (name, lat, lng) of the first listed city in the question; null sends the question to a remote geocoder."""
    low = F.lower(X.empty(question))
    return _first_match([(F.contains(low, F.lit(n)), F.struct(F.lit(n).alias("name"), F.lit(lat).alias("lat"), F.lit(lng).alias("lng"))) for n, lat, lng in CITIES])


def map_filter(question: Column) -> Column:
    """The category's filter, or a name pattern of the first three words, or any name."""
    low = F.lower(X.empty(question))
    known = []
    for keywords, tag in CATEGORIES:
        named = F.lit(False)
        for k in keywords:
            named = named | F.contains(low, F.lit(k))
        known.append((named, F.lit(tag)))
    names = F.slice(F.regexp_extract_all(X.empty(question), F.lit(NAME_WORD), F.lit(0)), 1, 3)
    by_name = F.concat(F.lit('["name"~"'), F.array_join(names, "|"), F.lit('",i]'))
    return F.coalesce(_first_match(known), F.when(F.size(names) > 0, by_name), F.lit('["name"~".",i]'))


def map_query(question: Column, lat: Column, lng: Column, radius_m: int = RADIUS_M, most: int = 100) -> Column:
    """The map server's query text for a question around a centre."""
    around = F.format_string(f"(around:{radius_m},%.4f,%.4f);", lat.cast("double"), lng.cast("double"))
    return F.concat(F.lit("[out:json][timeout:25];(nwr"), map_filter(question), around, F.lit(f");out center tags {most};"))


def map_places(elements: DataFrame) -> DataFrame:
    """Place rows of a map's elements (tags map, lat, lon, center_lat, center_lon): a name is required, the centre stands in
    for missing coordinates, the address joins the parts there are. Other columns pass."""
    tag = lambda *names: F.coalesce(*[F.when(F.col("tags")[n] != "", F.col("tags")[n]) for n in names], F.lit(""))
    own = [c for c in elements.columns if c not in ("tags", "lat", "lon", "center_lat", "center_lon", "name", "address", "phone", "hours", "website", "lng")]
    address = F.concat_ws("، ", *[F.when(F.col("tags")[p] != "", F.col("tags")[p]) for p in ADDRESS_PARTS])
    rows = elements.select(
        *own,
        F.substring(X.strip(tag("name", "name:fa")), 1, 300).alias("name"),
        F.substring(address, 1, 1000).alias("address"),
        F.substring(tag("phone", "contact:phone"), 1, 100).alias("phone"),
        F.substring(tag("opening_hours"), 1, 300).alias("hours"),
        F.substring(tag("website", "contact:website"), 1, 512).alias("website"),
        F.coalesce("lat", "center_lat").alias("lat"),
        F.coalesce("lon", "center_lon").alias("lng"),
    )
    return rows.filter("name <> ''")
