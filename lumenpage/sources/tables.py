"""Parquet scans and tables staged in the folder all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir or set as the context's checkpoint folder; a temporary one only where neither is set and
    all runs in one process. A cluster without a shared folder is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="lumenpage-")
            spark.sparkContext.setCheckpointDir(_LOCAL[app])
        named = _LOCAL[app]
    return named.rstrip("/")


_LOCAL: dict[str, str] = {}


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives a lost
    executor, and lets later steps prune columns. Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lumenpage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Free what finished queries leave: the driver keeps their plans, and their shuffle files and broadcasts stay, until it happens to collect its garbage."""
    try:
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(5000)  # events hold plans until they are read
    except Exception:  # other queries' events keep coming
        pass
    gc.collect()  # Python's references to plans first
    queue = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None) or ()
    for _ in range(len(queue)):  # a thread of py4j's lets go of these only once a second
        try:
            task = queue.pop()
        except IndexError:
            break
        if not isinstance(task, tuple):  # the end of that thread
            queue.appendleft(task)
            break
        task[0].garbage_collect_object(task[1], False)
    spark.sparkContext._jvm.System.gc()
    trim_native(spark)


def trim_native(spark: SparkSession) -> str:
    """Give back to the system what the C library of the driver's JVM keeps of freed native memory, such as the compiler's, which no limit of the heap bounds;
    what the JVM says of it, '' where it can't."""
    try:
        jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
        of = jvm.java.lang.Class.forName
        kinds, args = new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = of(kind)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        return of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(server, args)  # the server's own class is not open to calls
    except Exception:  # an older JVM, or another C library
        return ""


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        pass
