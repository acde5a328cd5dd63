"""Explicit schemas: never inferred."""

from pyspark.sql import types as T

CHANGESETS = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("changeset_id", T.StringType()),
    T.StructField("diff", T.StringType()),
])

# the message sink: ``slot`` tells answers without a repository apart
SINK = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("changeset_id", T.StringType()),
    T.StructField("slot", T.StringType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("error_class", T.StringType()),
    T.StructField("model_used", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("bucket", T.IntegerType()),
])

# driver tables (only the columns we read)
DRIVER = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "lineitem": ("l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                 "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                 "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ"),
    "orders": ("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
               "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"),
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}
