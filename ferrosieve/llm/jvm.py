"""Java source as functions of a session: compiled by Janino, which Spark brings for its own generated code, once an application, and sent to the executors as a jar."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_READY: set[str] = set()


def functions(spark: SparkSession, source: str, kinds: dict[str, tuple[int, str]]) -> None:
    """Make classes of ``source`` functions of the session under their names, once; of each, the number of arguments (``UDF<n>``) and the type of the result."""
    of = f"{spark.sparkContext.applicationId} {spark._jsparkSession.sessionUUID()} {sorted(kinds)}"
    if of in _READY:
        return
    jvm = spark.sparkContext._jvm
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook(source)
    path = os.path.join(tempfile.mkdtemp(prefix="ferrosieve-"), f"{min(kinds)}.jar")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, code in dict(compiler.getBytecodes()).items():
            z.writestr(f"{name.replace('.', '/')}.class", bytes(code))
    spark.sql(f"ADD JAR '{path}'")
    load, new_array = jvm.java.lang.Thread.currentThread().getContextClassLoader().loadClass, spark.sparkContext._gateway.new_array
    for name, (n, result) in kinds.items():
        types, given = new_array(jvm.java.lang.Class, 2), new_array(jvm.java.lang.Object, 2)
        types[0], types[1] = load(f"org.apache.spark.sql.api.java.UDF{n}"), load("org.apache.spark.sql.types.DataType")
        given[0], given[1] = load(name).newInstance(), jvm.org.apache.spark.sql.types.DataType.fromDDL(result)
        function = load("org.apache.spark.sql.functions").getMethod("udf", types).invoke(None, given)  # Py4J may take another ``udf``
        spark._jsparkSession.udf().register(name, function.asNondeterministic())  # so that it runs once a row
    _READY.add(of)
