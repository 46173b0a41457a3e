"""The catalogue of analysis views, with the base tables they read.

The project's tables hold files, folders, tokens and changes. Views over tables that only parsers of source code, schemas
or data files fill are run on stand-ins with the same columns, made from the star-schema tables by ``BASES``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from siltstone.operators.catalog import Catalog, View
from siltstone.session import table

# base table: portable SELECT over the driver's tables or other bases
BASES = {
    "files": "SELECT DISTINCT file_id, file_name, file_extension_id, size, units FROM file_details",
    "code_imports": "SELECT o_orderkey AS linkage_id, o_orderpriority AS import_name, o_orderstatus AS import_source, o_custkey AS by_file, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 97 END AS to_file, o_custkey % 3 = 0 AS is_external FROM orders",
    "code_functions": "SELECT p_partkey AS function_id, p_name AS function_name, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_partkey % 50 END AS class_id, p_size % 5 = 0 AS is_imported, CASE WHEN p_size % 3 = 0 THEN p_type END AS doc FROM part",
    "code_classes": "SELECT s_suppkey AS class_id, s_name AS class_name, s_suppkey % 4 = 0 AS is_imported, CASE WHEN s_acctbal > 0 THEN s_name END AS doc FROM supplier",
    "class_methods": "SELECT class_id, function_id FROM code_functions WHERE class_id IS NOT NULL",
    "kinds": "SELECT r_regionkey AS kind_id, r_name AS kind_name FROM region",
    "symbols": "SELECT c_custkey AS symbol_id, c_custkey % 211 AS file_id, c_nationkey % 5 AS kind_id, c_custkey % 977 AS target_id FROM customer",
    "introspection": "SELECT l_linenumber AS language, l_returnflag AS inspection_source FROM lineitem",
    "tensor_members": "SELECT p_type AS kind, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS n FROM part",
    "schema_databases": "SELECT n_nationkey AS db_id, CASE WHEN n_regionkey = 2 THEN NULL ELSE n_regionkey END AS db_engine FROM nation",
    "schema_tables": "SELECT s_suppkey AS table_id, s_name AS table_name, s_nationkey % 5 AS db_engine, CASE WHEN s_acctbal > 3000 THEN 'table' ELSE 'view' END AS table_kind, s_suppkey % 40 AS file_id FROM supplier",
    "schema_columns": "SELECT p_partkey AS column_id, p_type AS column_type, p_partkey % 90 AS table_id FROM part",
    "schema_keys": "SELECT c_custkey AS key_id, CASE c_nationkey % 3 WHEN 0 THEN 'FOREIGN KEY' WHEN 1 THEN 'PRIMARY KEY' ELSE 'UNIQUE' END AS key_type, c_custkey % 110 AS table_id, c_mktsegment AS referenced_table FROM customer",
    "schema_constraints": "SELECT c_mktsegment AS constraint_type FROM customer",
    "schema_triggers": "SELECT CASE c_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '(none)' WHEN 2 THEN 'BEFORE' ELSE 'AFTER' END AS timing FROM customer",
    "schema_methods": "SELECT CASE WHEN p_size % 6 = 0 THEN NULL ELSE p_brand END AS language, p_size % 2 AS method_kind FROM part",
    "schema_types": "SELECT CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_brand END AS type_category FROM part",
    "schema_indexes": "SELECT o_orderkey AS index_id, o_custkey % 120 AS table_id FROM orders",
    "schema_entities": "SELECT o_custkey % 300 AS file_id, o_orderstatus AS entity_kind FROM orders",
    "datasets": "SELECT o_orderkey AS dataset_id, o_orderpriority AS modality, o_orderstatus AS category, substr(o_orderpriority, 1, 1) AS file_format, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey END AS row_count, CASE WHEN o_custkey % 7 = 0 THEN 'failed' ELSE 'ok' END AS status, o_custkey % 300 AS file_id FROM orders",
    "data_columns": "SELECT l_orderkey AS dataset_id, l_linestatus AS inferred_type, l_shipdate AS seen FROM lineitem",
    "data_relations": "SELECT l_orderkey AS dataset_id, l_linenumber AS relation_id, CASE WHEN l_linenumber = 1 THEN 'correlation' ELSE 'reference' END AS relation_type, l_returnflag AS left_column, l_linestatus AS right_column, l_tax - l_discount AS value FROM lineitem",
    "data_tensors": "SELECT l_orderkey AS dataset_id, l_linenumber AS tensor_id, l_returnflag AS dtype, CAST(floor(l_quantity) AS BIGINT) AS num_elements, CAST(floor(l_quantity * 8) AS BIGINT) AS num_bytes FROM lineitem",
    "data_properties": "SELECT p_brand AS group_name FROM part",
}

V = View
_ALL = [
    # files and folders
    V("file_inventory", "files", "file_name=concat(files.file_name, coalesce(file_extensions.extension_name, '')), files.size, files.units, files.file_id", joins=(("file_extensions", "files.file_extension_id = file_extensions.extension_id", "inner"),), order="-size, file_id", limit=20),
    V("extension_distribution", "files", "file_extensions.extension_name", "files=count(*)", (("file_extensions", "files.file_extension_id = file_extensions.extension_id", "inner"),), order="-files, extension_name"),
    V("lineage_depths", "file_folder_lineage", "depth_index", "rows=count(*), files=count(DISTINCT file_id)", order="depth_index"),
    # code
    V("import_internal_vs_external", "code_imports", "kind=CASE WHEN is_external THEN 'external' ELSE 'internal' END", "links=count(*)", order="-links, kind"),
    V("import_edges", "code_imports", "linkage_id, import_name, import_source, by_file, to_file, scope=CASE WHEN is_external THEN 'ext' ELSE 'local' END", order="linkage_id", limit=25),
    V("top_classes_by_methods", "code_classes", "code_classes.class_id, code_classes.class_name", "method_count=count(class_methods.function_id)", (("class_methods", "code_classes.class_id = class_methods.class_id", "left"),), order="-method_count, class_name, class_id", limit=15),
    V("functions_defined_vs_imported", "code_functions", "origin=CASE WHEN is_imported THEN 'imported' ELSE 'defined' END", "n=count(*)", order="-n, origin"),
    V("symbols_by_kind", "symbols", "kinds.kind_name", "symbols=count(*)", (("kinds", "symbols.kind_id = kinds.kind_id", "inner"),), order="-symbols, kind_name"),
    V("introspection_by_language", "introspection", "language, inspection_source", "records=count(*)", order="-records, language, inspection_source"),
    V("tensor_members_by_kind", "tensor_members", "kind", "members=count(*), total_count=sum(coalesce(n, 0))", order="-members, kind"),
    # schemas
    V("schema_databases_by_engine", "schema_databases", "db_engine", "databases=count(*)", order="-databases, db_engine"),
    V("schema_tables_by_engine", "schema_tables", "db_engine", "tables=count(*)", order="-tables, db_engine"),
    V("schema_tables_by_kind", "schema_tables", "table_kind", "tables=count(*)", order="-tables, table_kind"),
    V("schema_top_column_types", "schema_columns", "column_type", "columns=count(*)", order="-columns, column_type", limit=20),
    V("schema_keys_by_type", "schema_keys", "key_type", "keys=count(*)", order="-keys, key_type"),
    V("schema_foreign_key_edges", "schema_keys", "schema_keys.key_id, schema_tables.table_name, schema_keys.referenced_table", joins=(("schema_tables", "schema_keys.table_id = schema_tables.table_id", "inner"),), where="schema_keys.key_type = 'FOREIGN KEY'", order="table_name, key_id", limit=25),
    V("schema_constraints_by_type", "schema_constraints", "constraint_type", "constraints=count(*)", order="-constraints, constraint_type"),
    V("schema_triggers_by_timing", "schema_triggers", "shown=coalesce(timing, '(none)')", "triggers=count(*)", group="timing", order="-triggers, shown"),
    V("schema_methods_by_language", "schema_methods", "shown=coalesce(language, '(none)'), method_kind", "methods=count(*)", group="language, method_kind", order="-methods, shown, method_kind"),
    V("schema_types_by_category", "schema_types", "shown=coalesce(type_category, '(none)')", "types=count(*)", group="type_category", order="-types, shown"),
    V("schema_top_indexed_tables", "schema_indexes", "schema_tables.table_id, schema_tables.table_name", "indexes=count(*)", (("schema_tables", "schema_indexes.table_id = schema_tables.table_id", "inner"),), order="-indexes, table_name, table_id", limit=15),
    V("schema_entities_per_file", "schema_entities", "files.file_id, files.file_name, schema_entities.entity_kind", "entities=count(*)", (("files", "schema_entities.file_id = files.file_id", "inner"),), order="-entities, file_id, entity_kind", limit=25),
    # data files
    V("data_datasets_by_modality", "datasets", "modality", "datasets=count(*)", order="-datasets, modality"),
    V("data_datasets_by_category", "datasets", "category, modality", "datasets=count(*)", order="-datasets, category, modality", limit=25),
    V("data_datasets_by_format", "datasets", "file_format", "datasets=count(*), bytes=sum(size_bytes)", order="-datasets, file_format"),
    V("data_analysis_status", "datasets", "status", "datasets=count(*)", order="-datasets, status"),
    V("data_largest_tabular", "datasets", "dataset_id, row_count, size_bytes", where="row_count IS NOT NULL", order="-row_count, dataset_id", limit=25),
    V("data_columns_by_inferred_type", "data_columns", "inferred_type", "columns=count(*)", order="-columns, inferred_type"),
    V("data_top_correlations", "data_relations", "datasets.dataset_id, data_relations.left_column, data_relations.right_column, value=round(data_relations.value, 6), strength=round(abs(data_relations.value), 6)", joins=(("datasets", "data_relations.dataset_id = datasets.dataset_id", "inner"),), where="data_relations.relation_type = 'correlation'", order="-strength, dataset_id", limit=25),
    V("data_tensors_by_dtype", "data_tensors", "dtype", "tensors=count(*), elements=sum(num_elements)", order="-tensors, dtype"),
    V("data_largest_tensors", "data_tensors", "datasets.dataset_id, data_tensors.tensor_id, data_tensors.num_bytes", joins=(("datasets", "data_tensors.dataset_id = datasets.dataset_id", "inner"),), order="-num_bytes, dataset_id, tensor_id", limit=25),
    V("data_properties_by_group", "data_properties", "group_name", "properties=count(*)", order="-properties, group_name", limit=25),
    V("data_entities_per_file", "datasets", "files.file_id, files.file_name", "datasets=count(*)", (("files", "datasets.file_id = files.file_id", "inner"),), order="-datasets, file_id", limit=25),
]
VIEWS = {v.name: v for v in _ALL}


def catalog(spark: SparkSession, d: str) -> Catalog:
    """All tables of a folder, the bases over them, and the views."""
    cat = Catalog(spark, {}, dict(VIEWS))
    driver = "region nation customer supplier part orders lineitem events documents embeddings folder_details file_details file_folder_lineage token_locations token_registry grep_pattern_catalog change_events file_state file_texts file_extensions eval_items mix_targets".split()
    for n in driver:
        cat.tables[n] = lambda n=n: table(spark, d, n)

    def base(sql: str) -> DataFrame:
        names = {n for n in re.findall(r"(?i)\b(?:FROM|JOIN)\s+(\w+)", sql)}
        text = re.sub(r"(?i)\b(FROM|JOIN)\s+(\w+)", r"\1 {\2}", sql)
        return spark.sql(text, **{n: cat.table(n) for n in names})

    for n, sql in BASES.items():
        cat.tables[n] = lambda sql=sql: base(sql)
    return cat


_SQL_BASES = BASES


def oracle(v: View) -> str:
    need: list[str] = []

    def add(n: str) -> None:
        if n in _SQL_BASES and n not in need:
            for m in re.findall(r"(?i)\b(?:FROM|JOIN)\s+(\w+)", _SQL_BASES[n]):
                if m != n:
                    add(m)
            need.append(n)

    for t in v.tables:
        add(t)
    return ("WITH " + ", ".join(f"{n} AS ({_SQL_BASES[n]})" for n in need) + " " if need else "") + v.sql()


def _query(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return catalog(spark, d).view(name)

    run.__name__ = f"view_{name}"
    return run


QUERIES = {f"view_{n}": _query(n) for n in VIEWS}
ORACLE = {f"view_{n}": oracle(v) for n, v in VIEWS.items()}
