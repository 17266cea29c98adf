"""Types and fixed values of the code graph and of the integration model."""

from __future__ import annotations

from pyspark.sql import types as T

ATTRIBUTES = T.MapType(T.StringType(), T.StringType())

NODES = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("attributes", ATTRIBUTES), T.StructField("evidence", T.StringType())])
EDGES = T.StructType([
    T.StructField("from_id", T.StringType()), T.StructField("to_id", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("label", T.StringType()), T.StructField("attributes", ATTRIBUTES), T.StructField("evidence", T.StringType()),
    T.StructField("confidence", T.DoubleType())])

# Kinds in the order of their numbers.
NODE_KINDS = ("Solution", "Project", "Namespace", "Type", "Method", "ExternalIntegration", "MessageChannel")
EDGE_KINDS = ("Contains", "DeclaredIn", "Calls", "ReferencesType", "Inherits", "Implements", "UsesExternal", "PublishesTo", "ConsumesFrom")
TYPE_KINDS = ("Class", "Struct", "Interface", "Enum", "Record", "Delegate")
INTEGRATION_KINDS = ("Database", "Cache", "MessageBus", "HttpApi", "Storage", "Secrets", "Observability")
EVIDENCE_KINDS = ("RoslynSymbol", "Invocation", "ConfigKey", "PackageReference", "IaC", "EnvVarKey", "SecretName", "UnresolvedName")

EVIDENCE = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("file_path", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("details", T.StringType())])
CANDIDATE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("technology", T.StringType()), T.StructField("logical_name", T.StringType()),
    T.StructField("endpoint", T.StringType()), T.StructField("endpoint_source", T.StringType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("evidence", T.ArrayType(EVIDENCE)), T.StructField("attributes", ATTRIBUTES)])
