"""Static dimensions: where teams play, and how they are grouped.

Fixed values: codes, coordinates and offsets from UTC in season are facts that
results depend on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# team, latitude, longitude, hours from UTC
HOMES = [
    ("ARI", 33.5276, -112.2626, -7.0), ("ATL", 33.7554, -84.4009, -5.0), ("BAL", 39.2780, -76.6227, -5.0), ("BUF", 42.7738, -78.7870, -5.0),
    ("CAR", 35.2258, -80.8528, -5.0), ("CHI", 41.8623, -87.6167, -6.0), ("CIN", 39.0955, -84.5160, -5.0), ("CLE", 41.5061, -81.6995, -5.0),
    ("DAL", 32.7473, -97.0945, -6.0), ("DEN", 39.7439, -105.0201, -7.0), ("DET", 42.3400, -83.0456, -5.0), ("GB", 44.5013, -88.0622, -6.0),
    ("HOU", 29.6847, -95.4107, -6.0), ("IND", 39.7601, -86.1639, -5.0), ("JAX", 30.3239, -81.6373, -5.0), ("KC", 39.0489, -94.4839, -6.0),
    ("LA", 33.9535, -118.3392, -8.0), ("LAC", 33.9535, -118.3392, -8.0), ("LV", 36.0909, -115.1833, -8.0), ("MIA", 25.9580, -80.2389, -5.0),
    ("MIN", 44.9737, -93.2581, -6.0), ("NE", 42.0909, -71.2643, -5.0), ("NO", 29.9511, -90.0812, -6.0), ("NYG", 40.8135, -74.0745, -5.0),
    ("NYJ", 40.8135, -74.0745, -5.0), ("OAK", 37.7516, -122.2005, -8.0), ("PHI", 39.9008, -75.1675, -5.0), ("PIT", 40.4468, -80.0158, -5.0),
    ("SD", 32.7831, -117.1196, -8.0), ("SEA", 47.5952, -122.3316, -8.0), ("SF", 37.4033, -121.9694, -8.0), ("STL", 38.6327, -90.1885, -6.0),
    ("TB", 27.9759, -82.5033, -5.0), ("TEN", 36.1665, -86.7713, -6.0), ("WAS", 38.9077, -76.8645, -5.0),
]
# team, first season, last season, latitude, longitude, hours from UTC
ERAS = [("LA", 2016, 2019, 34.0141, -118.2879, -8.0), ("LAC", 2017, 2019, 33.8644, -118.2611, -8.0)]
# stadium, latitude, longitude, hours from UTC
NEUTRAL = [
    ("LON00", 51.5560, -0.2795, 1.0), ("LON01", 51.4560, -0.3416, 1.0), ("LON02", 51.6043, -0.0665, 1.0), ("MEX00", 19.3029, -99.1505, -6.0),
    ("GER00", 48.2188, 11.6247, 2.0), ("MUN01", 48.2188, 11.6247, 2.0), ("FRA00", 50.0686, 8.6455, 2.0), ("SAO00", -23.5453, -46.4739, -3.0),
    ("RIO00", -22.9121, -43.2302, -3.0), ("MAD01", 40.4531, -3.6883, 2.0), ("PAR00", 48.9245, 2.3601, 2.0), ("MEL00", -37.8200, 144.9834, 10.0),
]
# stadium, the team whose home it is
STADIUMS = [
    ("PHO00", "ARI"), ("ATL97", "ATL"), ("BAL00", "BAL"), ("BUF00", "BUF"), ("CAR00", "CAR"), ("CHI98", "CHI"), ("CIN00", "CIN"), ("CLE00", "CLE"),
    ("DAL00", "DAL"), ("DEN00", "DEN"), ("DET00", "DET"), ("GNB00", "GB"), ("HOU00", "HOU"), ("IND00", "IND"), ("JAX00", "JAX"), ("KAN00", "KC"),
    ("LAX01", "LA"), ("LAX00", "LA"), ("LAX97", "LAC"), ("VEG00", "LV"), ("MIA00", "MIA"), ("MIN01", "MIN"), ("NWE00", "NE"), ("NOR00", "NO"),
    ("NYC01", "NYG"), ("OAK00", "OAK"), ("PHI00", "PHI"), ("PIT00", "PIT"), ("SDG00", "SD"), ("SEA00", "SEA"), ("SFO01", "SF"), ("STL00", "STL"),
    ("TAM00", "TB"), ("NAS00", "TEN"), ("WAS00", "WAS"),
]
# division, its teams
DIVISIONS = [
    ("AFC East", ["BUF", "MIA", "NE", "NYJ"]), ("AFC North", ["BAL", "CIN", "CLE", "PIT"]), ("AFC South", ["HOU", "IND", "JAX", "TEN"]),
    ("AFC West", ["DEN", "KC", "LAC", "LV", "OAK", "SD"]), ("NFC East", ["DAL", "NYG", "PHI", "WAS"]), ("NFC North", ["CHI", "DET", "GB", "MIN"]),
    ("NFC South", ["ATL", "CAR", "NO", "TB"]), ("NFC West", ["ARI", "LA", "SF", "SEA", "STL"]),
]


def homes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HOMES, "team string, lat double, lon double, tz double")


def eras(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ERAS, "team string, first int, last int, lat double, lon double, tz double")


def neutral(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NEUTRAL, "stadium_id string, lat double, lon double, tz double")


def stadiums(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STADIUMS, "stadium_id string, team string")


def divisions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, d) for d, ts in DIVISIONS for t in ts], "team string, division string")
