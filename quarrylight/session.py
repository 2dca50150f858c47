"""Session helpers: shipping the package, and tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own_dir: str | None = None
_written: dict[str, SparkSession] = {}


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once per application, so that
    they can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="quarrylight-")) / f"{root.name}.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary
    folder of this process will do for a local master (tests); on a cluster it is an error."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="quarrylight-")
    return _own_dir


def cut(df: DataFrame, distinct: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, so a
    lost executor costs a re-read instead of a recomputation. ``discard`` removes it.
    For columns of mostly ``distinct`` values no dictionary is tried."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ql-{uuid.uuid4().hex}"
    df.write.options(**{f"parquet.enable.dictionary#{c}": "false" for c in distinct}).parquet(path)
    _written[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back._ql_path = path
    return back


def discard(*dfs: DataFrame) -> None:
    """Remove tables made by ``cut`` that no later plan reads."""
    for df in dfs:
        path = getattr(df, "_ql_path", None)
        if path and _written.pop(path, None) is not None:
            _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_written.items()):
        if spark.sparkContext._jsc is None:  # stopped: the JVM is gone
            continue
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - at exit the gateway may already be closing
            return
