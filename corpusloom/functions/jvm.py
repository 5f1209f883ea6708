"""Sketch.java as a function of Spark SQL, built by the compiler that Spark has for its own generated code."""

from __future__ import annotations

import os
import pkgutil
import tempfile
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql.types import ArrayType, LongType

NAME, CLASS = "corpusloom_sketch", "corpusloom.Sketch"
_made: dict[str, tempfile.TemporaryDirectory] = {}


def sketch_function(spark: SparkSession) -> str | None:
    """Name of the function (normal binary, keys binary) -> array<bigint>; None where the session has no JVM (Spark Connect).

    The jar is made once in each application and goes to its executors, as `ADD JAR` does it.
    """
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return None
    application = spark.sparkContext.applicationId
    if application not in _made:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(pkgutil.get_data("corpusloom.functions", "Sketch.java").decode())
        folder = tempfile.TemporaryDirectory(prefix="corpusloom-")
        jar = os.path.join(folder.name, "corpusloom-sketch.jar")
        with zipfile.ZipFile(jar, "w") as out:
            for name, code in compiler.getBytecodes().items():
                out.writestr(name.replace(".", "/") + ".class", bytes(code))
        spark.sql(f"ADD JAR '{jar}'")
        _made[application] = folder
    session = spark._jsparkSession
    function = session.sharedState().jarClassLoader().loadClass(CLASS).newInstance()
    session.udf().register(NAME, function, session.parseDataType(ArrayType(LongType()).json()))
    return NAME
