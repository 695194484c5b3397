"""SQL twins of the table bindings in ``sources/tables.py`` (CTE bodies)."""

from ..sources.tables import LI_NUM, EM_DIMS

LI_CTE = (
    "li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    + ", ".join(LI_NUM)
    + ", l_linestatus, CAST(l_linenumber AS VARCHAR) AS l_linenumber_s, l_returnflag AS y FROM lineitem)"
)
LI_CAT = ("l_linestatus", "l_linenumber_s")

EM_NUM = tuple(f"e{i}" for i in range(EM_DIMS))
EM_CTE = (
    "em AS (SELECT vec_id AS row_id, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(EM_DIMS))
    + ", CAST(label AS VARCHAR) AS y FROM embeddings)"
)


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "
