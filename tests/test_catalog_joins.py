"""Rows made by an explode never go whole to all tasks, whatever size Spark expects; every database draws its own examples."""

import __spark_entry__ as entrypoint
import pytest
from querylight.operators import catalog

SF_DIR = "/root/testdata/sf0.001"
EXPLODED = ["cat_fk_filter", "cat_schema_text_dict", "prompt_conversation", "prompt_render", "sql_schema_link", "cat_flatten_dict"]


@pytest.mark.parametrize("name", EXPLODED)
def test_no_broadcast_of_exploded_rows(spark, name):
    plan = entrypoint.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan


def test_every_database_draws_its_own_examples(spark):
    values = spark.createDataFrame([("t", "a", f"v{i}", "codes") for i in range(30)], "tab string, col string, value string, enum_desc string")
    cols = spark.range(40).selectExpr("concat('db_', id) as db_id", "0 as tab_idx", "'t' as tab", "0 as col_idx", "'a' as col", "'int' as type",
                                      "'none' as description", "'' as table_description")
    fks = spark.createDataFrame([], "db_id string, fk_idx int, t1 string, c1 string, t2 string, c2 string")
    own = values.crossJoin(cols.select("db_id"))
    assert len({r["examples"] for r in catalog.value_examples(own).collect()}) > 20
    texts = [
        {r["db_id"]: r["schema_text"].partition("\n")[2] for r in render.collect()}
        for enums in (values, own)
        for render in (catalog.schema_text_rich(cols, fks, enums), catalog.schema_text_names(cols, fks, enums))
    ]
    assert texts[0] == texts[2] and texts[1] == texts[3]
    assert len(set(texts[0].values())) > 20 and len(set(texts[1].values())) > 20
