"""Explicit schemas of the engine's relations; readers never infer."""

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def _fields(text: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "l": T.LongType(), "i": T.IntegerType(), "t": T.TimestampNTZType(), "p": POINT}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (f.split(":") for f in text.split())])


SIGNALS = _fields("mac_address:s date_time:t location:s store_id:s x:d y:d wifi_type:s email:s")
FEATURES = _fields(
    "mac_address:s frequency:l centroid:p radius_of_gyration:d manufacturer:s count_density_variance:d length_of_stay:l"
    " is_out_of_hours:i av_speed:d av_turning_angle:d total_turning_angle:d av_turning_angle_velocity:d av_path_length:d"
    " total_path_length:d av_straightness:d av_speed_from_total:d turning_angle_density:d start_coordinate:p"
    " end_coordinate:p wifi_type:s start_time:t end_time:t number_of_shops:l"
)
SHOPS_V1 = _fields("store_id:s store_name:s store_category:s")
SHOPS_V2 = _fields("frequency:l store_id:s area:d centroid:p x:d y:d count_of_shoppers:l")
OUI = T.StructType([T.StructField("Assignment", T.StringType()), T.StructField("Organization Name", T.StringType())])
COMMUNITIES = _fields("mac_address:s community:i")
EDGES = _fields("src:s dst:s weight:d")
INITIAL = _fields("store_id:s p:d")
STORE_TEXT = _fields("store_name:s text:s")

#: The three malls, and the kinds of connection in order of priority (fixed values; one ends in a space).
MALLS = ("Mall of Mauritius", "Phoenix Mall", "Home & Leisure")
WIFI_TYPES = ("wifiuser", "lawifiuser", "Discovered-AP", "fatti Bot ", "unknown")
