import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.driver.memory", "3g").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.addPyFile(_package())
    yield s
    s.stop()


def _package() -> str:
    import tempfile
    import zipfile

    here = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp()) / "maploom_package.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in (here / "maploom").rglob("*.py"):
            z.write(p, p.relative_to(here))
    return str(out)
