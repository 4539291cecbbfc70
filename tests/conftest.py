import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from drawfield.session import configure
    builder = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))))
    session = configure(builder).getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


GEO = ("priogrid_id long, pg_xcoord double, pg_ycoord double, country_iso_a3 string,"
       "admin1_gaul1_code long, admin1_gaul1_name string, admin1_gaul0_code long,"
       "admin1_gaul0_name string, admin2_gaul2_code long, admin2_gaul2_name string")


@pytest.fixture(scope="session")
def geo(spark):
    return spark.createDataFrame([
        (100, 10.0, 20.0, "AAA", 1, "Region1", 10, "Province1", 100, "District1"),
        (101, 11.0, 21.0, "AAA", 1, "Region1", 10, "Province1", 101, "District2"),
        (102, 12.0, 22.0, "BBB", 2, "Region2", 20, "Province2", 200, "District3"),
        (103, 13.0, 23.0, "BBB", 2, "Region2", 20, "Province2", 201, "District4")], GEO)


@pytest.fixture(scope="session")
def posterior(spark):
    rows = [(m, 100 + c, [float(10 * (c + 1) + j + (m - 600)) for j in range(5)])
            for m in (600, 601) for c in range(4)]
    return spark.createDataFrame(rows, "month_id int, priogrid_id long, pred_lr_ged_sb array<float>")
