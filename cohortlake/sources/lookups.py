"""Year and age tables. They are a few dozen rows each, so joins with them are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Price index (2010 = 100), nominal minimum wage and nominal taxable maximum (thousands), by year.
FIRST_YEAR = 1959
PRICE_INDEX = (
    17.262, 17.546, 17.730, 17.939, 18.149, 18.414, 18.681, 19.155, 19.637, 20.402, 21.327, 22.325, 23.274, 24.070, 25.368, 28.009, 30.348, 32.013, 34.091, 36.479,
    39.714, 43.978, 47.908, 50.553, 52.729, 54.724, 56.661, 57.887, 59.650, 61.974, 64.641, 64.641, 67.440, 69.652, 71.494, 73.279, 74.803, 76.356, 77.981, 79.327,
    79.936, 81.110, 83.131, 84.736, 85.873, 87.572, 89.703, 92.261, 94.729, 97.101, 100.065, 100.000, 101.653, 104.149, 106.062,
)
MINIMUM_WAGE = (
    1.00, 1.00, 1.00, 1.15, 1.15, 1.25, 1.25, 1.25, 1.25, 1.40, 1.60, 1.60, 1.60, 1.60, 1.60, 1.60, 2.00, 2.10, 2.10, 2.30, 2.65, 2.90, 3.10, 3.35, 3.35, 3.35, 3.35, 3.35,
    3.35, 3.35, 3.35, 3.35, 3.80, 4.25, 4.25, 4.25, 4.25, 4.25, 4.75, 5.15, 5.15, 5.15, 5.15, 5.15, 5.15, 5.15, 5.15, 5.15, 5.15, 5.85, 6.55, 7.25, 7.25, 7.25, 7.25,
)
TAXABLE_MAXIMUM = (
    4.8, 4.8, 4.8, 4.8, 4.8, 4.8, 4.8, 6.6, 6.6, 7.8, 7.8, 7.8, 7.8, 9.0, 10.8, 13.2, 14.1, 15.3, 16.5, 17.7, 22.9, 25.9, 29.7, 32.4, 35.7, 37.8, 39.6, 42.0, 43.8,
    45.0, 48.0, 51.3, 53.4, 55.5, 57.6, 60.6, 61.2, 62.7, 65.4, 68.4, 72.6, 76.2, 80.4, 84.9, 87.0, 87.9, 90.0, 94.2, 97.5, 102.0, 106.8, 106.8, 106.8, 110.1, 113.7,
)
# Consumer prices of the survey's years, 1996 to 2013.
SURVEY_PRICES = (77.827, 79.613, 80.853, 82.639, 85.417, 87.847, 89.236, 91.270, 93.700, 96.875, 100.000, 102.848, 106.797, 106.417, 108.163, 111.577, 113.886, 115.554)
# Mean income by age, 25 to 60.
AGE_PROFILE = (
    14684.66, 16470.99, 18153.65, 19725.39, 21155.31, 22480.42, 23731.53, 24906.15, 26018.16, 27033.44, 28021.29, 28896.04, 29745.70, 30562.53, 31287.69, 31915.91, 32641.18, 33263.63,
    33806.89, 34273.58, 34757.48, 35178.49, 35638.08, 36025.42, 36439.55, 36740.32, 37034.68, 37170.10, 37321.69, 37353.06, 37295.95, 37027.27, 36245.12, 35758.03, 35102.58, 34318.51,
)
BASE_YEAR = 2010


def year_rows() -> list[tuple[int, float, float, float]]:
    return [(FIRST_YEAR + i, *x) for i, x in enumerate(zip(PRICE_INDEX, MINIMUM_WAGE, TAXABLE_MAXIMUM, strict=True))]


def year_table(spark: SparkSession) -> DataFrame:
    """yr, cpi, minwage, taxmax."""
    return spark.createDataFrame(year_rows(), "yr long, cpi double, minwage double, taxmax double")


def age_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(25 + i, x) for i, x in enumerate(AGE_PROFILE)], "age long, agedum double")


def survey_prices(spark: SparkSession) -> DataFrame:
    """yr, price, scaled so that 2010 is 100."""
    base = SURVEY_PRICES[2010 - 1996]
    return spark.createDataFrame([(1996 + i, 100 * x / base) for i, x in enumerate(SURVEY_PRICES)], "yr long, price double")
