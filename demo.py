"""Three clouds and their topology: a Y of points, a cylinder and a Y of tubes. Run: python demo.py"""

from pyspark.sql import SparkSession

import curvewright as cw
from curvewright.config import build_config
from curvewright.sources.clouds import DATASETS


def main() -> None:
    spark = SparkSession.builder.master("local[*]").appName("demo").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    for key in ("y_junction", "cylinder", "y_tube"):
        points, meta = cw.generate(spark, key)
        found = cw.extract(points, build_config(DATASETS[key]["recommended_config"]))
        print(key, meta["category"], meta["truth"]["branch_points"])
        found.show()
        found.branch_points.show(truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
