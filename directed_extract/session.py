"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings for a stand-alone run; a cluster's own settings win because only unset keys are filled.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and the local benchmark."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("directed_extract").config("spark.driver.memory", memory)
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": "8", **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def session(app: str = "directed_extract") -> SparkSession:
    """The session of a command: its master and resources are those of ``spark-submit`` or the configuration.

    Only settings that nobody has made get the defaults.
    """
    spark = SparkSession.builder.appName(app).getOrCreate()
    set_already = dict(spark.sparkContext.getConf().getAll())
    for k, v in DEFAULTS.items():
        if k not in set_already and k.startswith("spark.sql."):
            spark.conf.set(k, v)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for reliable checkpoints.

    The cluster's ``spark.checkpoint.dir`` is used when it is set (every executor can reach it). A session without it
    gets a temporary folder only if its master is local, as in tests on one machine; on a cluster it is an error, since
    no other machine could read such a folder.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not configured and not is_local(sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="directed_extract_"))
    return sc._jsc.sc().getCheckpointDir().get()


def is_local(master: str) -> bool:
    """All work is done in this one process."""
    return master == "local" or master.startswith("local[")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there.

    Used where several later stages read the same costly result: each would otherwise run it again. The files are
    reliable, so a lost executor costs nothing but its running tasks.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
