"""Session settings that suit wide record decodes."""

from __future__ import annotations

import tempfile
import uuid

#: Methods over 8000 bytes of bytecode are never compiled by the JVM. With this limit Spark
#: gives up one fused method for split ones instead, which do get compiled.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def tuned(builder):
    """The session builder with SETTINGS applied."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def scratch(spark) -> str:
    """A folder of its own, shared by driver and executors, that goes when the driver ends.

    It lies in the folder that spark.checkpoint.dir names; only without a cluster may that be unset.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="mainspring-")
        spark.conf.set("spark.checkpoint.dir", path)
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/mainspring-{uuid.uuid4().hex}")
    system = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(own)
    system.deleteOnExit(own)
    return own.toString()
