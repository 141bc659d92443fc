"""Small lookup tables: grid intensity and overhead of regions, and idle and full power of cloud instances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Power usage effectiveness of the providers.
PUE = {"aws": 1.15, "gcp": 1.09, "azure": 1.17, "generic": 1.5}
# Annual grams of CO2 equivalent per kWh (public yearly electricity data by country; subnational grids by hand).
COUNTRY_G_PER_KWH = {
    "fr": 41.5, "de": 329.6, "gb": 217.4, "uk": 217.4, "us": 384.4, "ie": 255.9, "se": 35.4, "no": 28.1, "jp": 477.4, "in": 670.5, "au": 524.6, "sg": 497.1,
    "nl": 253.6, "be": 109.3, "fi": 57.5, "it": 284.6, "es": 153.6, "pl": 590.8, "ca": 13.0, "br": 96.0,
}
# Regions of each provider and the grid that feeds them, a country or its own figure.
REGION_GRID = {
    "aws": {
        "eu-west-1": "ie", "eu-west-2": "gb", "eu-west-3": "fr", "eu-central-1": "de", "eu-north-1": "se", "ap-northeast-1": "jp", "ap-southeast-1": "sg", "eu-west-4": "nl", "eu-south-1": "it",
        "ap-southeast-2": "au", "ap-south-1": "in", "us-east-1": 379.0, "us-east-2": 410.0, "us-west-1": 200.0, "us-west-2": 89.0, "ca-central-1": "ca", "sa-east-1": "br",
    },
    "gcp": {
        "europe-west1": "be", "europe-west4": "nl", "europe-west9": "fr", "europe-north1": "fi", "europe-west8": "it", "europe-southwest1": "es", "europe-central2": "pl", "europe-north2": "no",
        "asia-northeast1": "jp", "us-central1": 426.0, "us-east1": 379.0, "us-west1": 89.0,
    },
    "azure": {"westeurope": "nl", "northeurope": "ie", "francecentral": "fr", "uksouth": "gb", "eastus": 379.0, "westus2": 89.0},
    "generic": {c: c for c in COUNTRY_G_PER_KWH},
}
# Watts of one virtual CPU, idle and full, by processor generation (public cloud coefficients), and memory premium.
VCPU_WATTS = {"cascade_lake": (0.690, 4.063), "naples": (0.847, 2.604)}
MEMORY_PREMIUM = (0.16, 0.40)
# Instance families with their generation and whether they carry the memory premium; sizes in virtual CPUs.
FAMILIES = {"t3": ("cascade_lake", False), "t3a": ("naples", False), "m5": ("cascade_lake", False), "m5a": ("naples", False), "r5": ("cascade_lake", True), "r5a": ("naples", True)}
SIZES = {"nano": 2, "micro": 2, "small": 2, "medium": 2, "large": 2, "xlarge": 4, "2xlarge": 8, "4xlarge": 16, "8xlarge": 32, "12xlarge": 48, "16xlarge": 64, "24xlarge": 96}
# Parameters: watts of an instance that no row names, by provider.
PROVIDER_WATTS = {"aws": (1.4, 8.1), "gcp": (1.4, 8.1), "azure": (1.4, 8.1), "generic": (5.0, 50.0)}


def region_rows() -> list[tuple[str, float, str, float]]:
    return [(region, COUNTRY_G_PER_KWH[grid] if isinstance(grid, str) else grid, provider, PUE[provider]) for provider, own in REGION_GRID.items() for region, grid in own.items()]


def region_intensity(spark: SparkSession, rows: list[tuple[str, float, str, float]] | None = None) -> DataFrame:
    """region, intensity (g/kWh), provider, pue; well under a hundred rows, so joins may broadcast it."""
    return spark.createDataFrame(rows or region_rows(), "region string, intensity double, provider string, pue double")


def instance_power(spark: SparkSession) -> DataFrame:
    """instance_type, idle_watts, max_watts: virtual CPUs times the coefficients of the family."""
    rows = []
    for family, (generation, memory) in FAMILIES.items():
        for name, cpus in SIZES.items():
            idle, full = (w + m * memory for w, m in zip(VCPU_WATTS[generation], MEMORY_PREMIUM, strict=True))
            rows.append((f"{family}.{name}", round(cpus * idle, 1), round(cpus * full, 1)))
    return spark.createDataFrame(rows, "instance_type string, idle_watts double, max_watts double")


def with_instance_power(df: DataFrame, instance_col: str = "instance_type", provider_col: str = "provider") -> DataFrame:
    """df with idle_watts and max_watts: of the instance type, else of the provider, else the generic ones."""
    spark = df.sparkSession
    defaults = F.create_map(*[x for p, w in PROVIDER_WATTS.items() for x in (F.lit(p), F.array(*map(F.lit, w)))])
    own = df.join(F.broadcast(instance_power(spark).withColumnRenamed("instance_type", "_type")), F.col(instance_col) == F.col("_type"), "left").drop("_type")
    default = F.coalesce(defaults[F.lower(provider_col)], defaults[F.lit("generic")])
    return own.withColumns({"idle_watts": F.coalesce("idle_watts", default[0]), "max_watts": F.coalesce("max_watts", default[1])})
