"""Metadata payloads and dictionary rows made of the driver's tables, discovered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unisource.functions import text, types
from unisource.operators import dictionary, dynamics, edmx, fields, relations, sage, sap
from unisource.plans import dispatch
from unisource.plans.queries.registry import payload, pick, query, sql_pick, table
from unisource.session import scratch_path

_FIELD = ["position", "name", "type", "native_type", "nullable", "primary_key", "foreign_key"]

# ---- metadata documents ----

_EDM_NATIVE = ["Edm.String", "Edm.Int32", "Edm.Decimal", "Edm.Double", "Edm.Guid", "Edm.SByte", "Edm.Binary", "Edm.Date"]
_EDM_TYPE = ["string", "integer", "decimal", "float", "uuid", "string", "string", "date"]
_EDMX_HEAD = (
    '<?xml version="1.0" encoding="utf-8"?><edmx:Edmx Version="4.0" '
    'xmlns:edmx="http://docs.oasis-open.org/odata/ns/edmx"><edmx:DataServices>'
    '<Schema Namespace="NS" xmlns="http://docs.oasis-open.org/odata/ns/edm" '
    'xmlns:sap="http://www.sap.com/Protocols/SAPData">'
)
_EDMX_TAIL = "</Schema></edmx:DataServices></edmx:Edmx>"


def _entity_xml(prefix: str, key: Column, native: Column, target: Column) -> Column:
    return F.concat(
        F.lit(f'<EntityType Name="{prefix}'), key,
        F.lit(
            '"><Key><PropertyRef Name="id"/></Key><Property Name="id" Type="Edm.Int64" Nullable="false" '
            'sap:label="Key"/><Property Name="attr" Type="'
        ),
        native, F.lit('"/><NavigationProperty Name="owner" Type="'), target, F.lit('"/></EntityType>'),
    )


def _edmx_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per order: an entity, an empty and an abstract one."""
    key = F.col("o_orderkey")
    target = F.when(key % 2 == 0, F.concat(F.lit("NS.C"), "o_custkey")).otherwise(
        F.concat(F.lit("Collection(NS.C"), "o_custkey", F.lit(")"))
    )
    body = F.concat(
        F.lit(_EDMX_HEAD), _entity_xml("O", key, pick(_EDM_NATIVE, key % 8), target),
        F.lit('<EntityType Name="Empty"/><EntityType Name="Base" Abstract="TRUE"><Property Name="x"/></EntityType>'),
        F.lit(_EDMX_TAIL),
    )
    return payload(table(spark, sf_dir, "orders"), "shop", F.lit("meta"), key, body)


_ORDER_TARGET = "CASE o_orderkey % 2 WHEN 0 THEN 'NS.C' || o_custkey ELSE 'Collection(NS.C' || o_custkey || ')' END"


def _edmx_sql(entity_type: str, abstract: bool) -> str:
    base = f"""
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'Base', '{entity_type}', CAST(0 AS INTEGER), 'x', 'string', 'Edm.String',
 true, false, false FROM orders"""
    return f"""
SELECT CAST(o_orderkey AS VARCHAR) AS path, 'O' || o_orderkey AS entity, '{entity_type}' AS entity_type,
 CAST(0 AS INTEGER) AS position, 'id' AS name, 'integer' AS type, 'Edm.Int64' AS native_type, false AS nullable,
 true AS primary_key, false AS foreign_key FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'O' || o_orderkey, '{entity_type}', CAST(1 AS INTEGER), 'attr',
 {sql_pick(_EDM_TYPE, "o_orderkey % 8")}, {sql_pick(_EDM_NATIVE, "o_orderkey % 8")}, true, false, false FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'O' || o_orderkey, '{entity_type}', CAST(2 AS INTEGER), 'owner', 'relation',
 {_ORDER_TARGET}, true, false, true FROM orders{base if abstract else ""}"""


@query("edmx_fields", _edmx_sql("odata_entity", abstract=True))
def edmx_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edmx.edmx_fields(_edmx_orders(spark, sf_dir))
    return found.select("path", "entity", "entity_type", *_FIELD)


@query("edmx_fields_dynamics", _edmx_sql("dynamics_entity", abstract=False))
def edmx_fields_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edmx.edmx_fields(_edmx_orders(spark, sf_dir), "dynamics")
    return found.select("path", "entity", "entity_type", *_FIELD)


@query("edmx_split", """
SELECT 'O' || o_orderkey AS entity, CAST(f.position AS INTEGER) AS position, f.name, f.type
FROM orders, (VALUES (0, 'id', 'integer'), (1, 'attr', 'integer'), (2, 'owner', 'relation')) AS f(position, name, type)""")
def edmx_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata files with an entity type per order, read element by element."""
    key = F.col("o_orderkey")
    element = _entity_xml("O", key, F.lit("Edm.Int32"), F.concat(F.lit("NS.C"), "o_custkey"))
    folder = scratch_path(spark, "edmx")
    table(spark, sf_dir, "orders").select(F.concat(F.lit("<!-- order -->"), element).alias("value")).write.text(folder)
    return edmx.edmx_file_fields(spark, folder, "shop").select("entity", "position", "name", "type")


@query("edmx_keys", """
SELECT CAST(o_orderkey AS VARCHAR) AS path, 'O' || o_orderkey AS entity, CAST(0 AS INTEGER) AS key_no, 'id' AS field
FROM orders""")
def edmx_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edmx.edmx_keys(_edmx_orders(spark, sf_dir)).select("path", "entity", "key_no", "field")


@query("nav_relations", """
SELECT 'shop' AS source_id, 'O' || o_orderkey AS source_entity, 'C' || o_custkey AS target_entity,
 'owner' AS source_field, 'id' AS target_field,
 CASE o_orderkey % 2 WHEN 0 THEN 'many_to_one' ELSE 'one_to_many' END AS relation_type FROM orders""")
def nav_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edmx.nav_relations(_edmx_orders(spark, sf_dir))


@query("sap_service_entities", """
WITH docs AS (
 SELECT c_custkey, n.k, 'sys' || c_custkey AS source_id,
  CASE WHEN c_custkey % 3 = 0 THEN 1 WHEN c_custkey % 3 = 1 THEN 3 ELSE 0 END AS listed
 FROM customer, (VALUES (0), (1), (2)) AS n(k))
SELECT source_id, CASE listed WHEN 3 THEN 'SVC' || k || '__' ELSE '' END || 'E' || c_custkey AS entity,
 f.position, f.name, f.description
FROM docs, (VALUES (CAST(0 AS INTEGER), 'id', 'Key'), (CAST(1 AS INTEGER), 'attr', ''),
  (CAST(2 AS INTEGER), 'owner', '')) AS f(position, name, description)
WHERE listed = 0 OR k < listed""")
def sap_service_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer a gateway with one, three or no listed services, and three metadata documents."""
    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    source = F.concat(F.lit("sys"), key)
    listing = (
        F.when(key % 3 == 0, '{"value":[{"TechnicalServiceName":"SVC0"},{"TechnicalServiceName":""},{"x":1}]}')
        .when(
            key % 3 == 1,
            '{"value":[{"TechnicalServiceName":"SVC0"},{"TechnicalServiceName":"SVC1"},{"TechnicalServiceName":"SVC2"}]}',
        )
        .otherwise("<html>no catalog</html>")
    )
    catalogs = payload(customers, source, F.lit(""), F.lit("catalog"), listing)
    body = F.concat(
        F.lit(_EDMX_HEAD), _entity_xml("E", key, F.lit("Edm.Time"), F.lit("NS.X")), F.lit(_EDMX_TAIL)
    )
    services = customers.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    documents = payload(services, source, F.concat(F.lit("SVC"), "k"), F.col("k"), body)
    return sap.service_fields(catalogs, documents).select("source_id", "entity", "position", "name", "description")


# ---- SAP dictionary ----

_ABAP_NATIVE = ["CHAR", "DATS", "INT4", "CURR", "F", "INT8", "TIMS", "N"]
_ABAP_TYPE = ["string", "date", "integer", "decimal", "float", "string", "string", "string"]


@query("abap_fields", f"""
SELECT 'T' || p_partkey AS entity, CAST(0 AS INTEGER) AS position, 'MANDT' AS name, 'string' AS type, 'C' AS native_type,
 true AS primary_key, 'client' AS description FROM part WHERE p_partkey % 5 <> 0
UNION ALL
SELECT 'T' || p_partkey, CAST(1 AS INTEGER), 'VAL', {sql_pick(_ABAP_TYPE, "p_size % 8")},
 {sql_pick(_ABAP_NATIVE, "p_size % 8")}, false, p_name FROM part WHERE p_partkey % 5 <> 0
UNION ALL
SELECT 'T' || p_partkey, CAST(2 AS INTEGER), 'NOTYPE', 'string', '', false, '' FROM part WHERE p_partkey % 5 <> 0""")
def abap_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dictionary table per part; every fifth has no field and goes."""
    body = F.when(F.col("p_partkey") % 5 == 0, '{"FIELDS":[]}').otherwise(
        F.concat(
            F.lit('{"FIELDS":[{"FIELDNAME":"MANDT","DATATYPE":"C","KEYFLAG":"X","FIELDTEXT":"client"},'
                  '{"FIELDNAME":"VAL","DATATYPE":"'),
            pick(_ABAP_NATIVE, F.col("p_size") % 8), F.lit('","KEYFLAG":"","FIELDTEXT":"'), "p_name",
            F.lit('"},{"FIELDNAME":"NOTYPE"}]}'),
        )
    )
    landed = payload(table(spark, sf_dir, "part"), "sap", F.concat(F.lit("T"), "p_partkey"), F.lit("ddic"), body)
    return sap.abap_fields(landed).select(
        "entity", "position", "name", "type", "native_type", "primary_key", "description"
    )


@query("bapi_fields", """
SELECT 'BAPI_' || p_partkey AS entity, CAST(0 AS INTEGER) AS position, 'AMOUNT' AS name, 'decimal' AS type,
 'CURR' AS native_type, p_name AS description FROM part WHERE p_partkey % 4 <> 0
UNION ALL SELECT 'BAPI_' || p_partkey, CAST(1 AS INTEGER), 'RETURN', 'string', 'BAPIRET2', '' FROM part
WHERE p_partkey % 4 <> 0
UNION ALL SELECT 'BAPI_' || p_partkey, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 4 = 0""")
def bapi_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("p_partkey") % 4 == 0, '{"PARAMS_AND_EXCPS":[]}').otherwise(
        F.concat(
            F.lit('{"PARAMS_AND_EXCPS":[{"PARAMETER":"AMOUNT","TABNAME":"CURR","PARAMTEXT":"'), "p_name",
            F.lit('"},{"PARAMETER":"RETURN","TABNAME":"BAPIRET2"}]}'),
        )
    )
    landed = payload(table(spark, sf_dir, "part"), "sap", F.concat(F.lit("BAPI_"), "p_partkey"), F.lit("fm"), body)
    return sap.bapi_fields(landed).select("entity", "position", "name", "type", "native_type", "description")


def _listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing reply per part, of its brand's system."""
    body = F.concat(
        F.lit('{"DATA":[{"WA":"  '), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")),
        F.lit('\\t"},{"WA":"   "},{"WA":"T'), "p_partkey", F.lit('"}]}'),
    )
    path = F.lpad(F.col("p_partkey").cast("string"), 12, "0")
    return payload(table(spark, sf_dir, "part"), F.col("p_brand"), F.lit("DD02L"), path, body)


@query("rfc_rows", """
SELECT p_brand AS source_id, lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS path, CAST(0 AS INTEGER) AS row_no,
 replace(p_name, ' ', '_') AS wa FROM part
UNION ALL
SELECT p_brand, lpad(CAST(p_partkey AS VARCHAR), 12, '0'), CAST(2 AS INTEGER), 'T' || p_partkey FROM part""")
def rfc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sap.rfc_rows(_listings(spark, sf_dir))


@query("rfc_listed_tables", """
SELECT source_id, table_name, table_no FROM (
 SELECT source_id, wa AS table_name,
  CAST(row_number() OVER (PARTITION BY source_id ORDER BY path, row_no) AS INTEGER) AS table_no
 FROM (
  SELECT p_brand AS source_id, p_partkey AS path, 0 AS row_no, replace(p_name, ' ', '_') AS wa FROM part
  UNION ALL SELECT p_brand, p_partkey, 2, 'T' || p_partkey FROM part))
WHERE table_no <= 200""")
def rfc_listed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sync's own limit: the first 200 tables a system lists."""
    return sap.listed_tables(sap.rfc_rows(_listings(spark, sf_dir)), max_tables=200).select("source_id", "table_name", "table_no")


@query("rfc_columns", """
SELECT CAST(p_partkey AS VARCHAR) AS "TABNAME", p_type AS "CLASS" FROM part WHERE p_type <> 'ECONOMY'""")
def rfc_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-width work areas cut by offset, with a projection and a predicate."""
    wa = F.concat(F.rpad(F.col("p_partkey").cast("string"), 12, " "), F.rpad("p_type", 20, " "))
    body = F.concat(
        F.lit('{"FIELDS":[{"FIELDNAME":"TABNAME","OFFSET":"000000","LENGTH":"000012"},'
              '{"FIELDNAME":"CLASS","OFFSET":"000012","LENGTH":"000020"}],"DATA":[{"WA":"'),
        wa, F.lit('"}]}'),
    )
    landed = payload(table(spark, sf_dir, "part"), F.col("p_brand"), F.lit("DD02L"), F.col("p_partkey"), body)
    return sap.rfc_columns(landed, ["TABNAME", "CLASS"], where=F.col("CLASS") != "ECONOMY").select("TABNAME", "CLASS")


# ---- Dynamics ----

_ATTRIBUTE_NATIVE = ["Lookup", "Picklist", "Money", "Double", "DateTime", "Memo", "Uniqueidentifier", "EntityName"]
_ATTRIBUTE_TYPE = ["uuid", "integer", "decimal", "float", "datetime", "string", "uuid", "string"]


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    body = F.concat(
        F.lit('{"value":[{"LogicalName":"acc_'), key, F.lit('","IsIntersect":false,"IsCustomEntity":'),
        (key % 2 == 0).cast("string"), F.lit(',"PrimaryIdAttribute":"acc_id"'),
        F.when(key % 4 == 0, "").otherwise(',"PrimaryNameAttribute":"title"'), F.lit(',"DisplayName":'),
        F.when(key % 3 == 0, F.concat(F.lit('{"UserLocalizedLabel":{"Label":"'), "c_name", F.lit('"}}')))
        .when(key % 3 == 1, '{"UserLocalizedLabel":null}').otherwise("null"),
        F.lit('},{"LogicalName":"link","IsIntersect":true}]}'),
    )
    return payload(table(spark, sf_dir, "customer"), "crm", F.lit(""), key, body)


_LABEL = "CASE c_custkey % 3 WHEN 0 THEN c_name ELSE 'acc_' || c_custkey END"
_DESCRIPTION = f"{_LABEL} || CASE c_custkey % 2 WHEN 0 THEN ' (Custom)' ELSE ' (Standard)' END"
_NAME = "CASE c_custkey % 4 WHEN 0 THEN 'name' ELSE 'title' END"


def _pair_sql(where: str) -> str:
    return f"""
SELECT 'acc_' || c_custkey AS entity, {_DESCRIPTION} AS entity_description, CAST(0 AS INTEGER) AS position,
 'acc_id' AS name, 'uuid' AS type, 'Edm.Guid' AS native_type, false AS nullable, true AS primary_key,
 false AS foreign_key, '' AS description FROM customer WHERE {where}
UNION ALL SELECT 'acc_' || c_custkey, {_DESCRIPTION}, CAST(1 AS INTEGER), {_NAME}, 'string', 'Edm.String', true, false,
 false, '' FROM customer WHERE {where}"""


@query("dynamics_entities", _pair_sql("true"))
def dynamics_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dynamics.definition_fields(_definitions(spark, sf_dir))
    return found.select("entity", "entity_description", *_FIELD, "description")


@query("dynamics_attributes", _pair_sql("c_custkey % 5 = 1 OR c_mktsegment = 'BUILDING'") + f"""
UNION ALL SELECT 'acc_' || c_custkey, {_DESCRIPTION}, CAST(0 AS INTEGER), 'own_id', 'uuid', 'Uniqueidentifier', false,
 true, false, 'Own id' FROM customer WHERE c_custkey % 5 <> 1 AND c_mktsegment <> 'BUILDING'
UNION ALL SELECT 'acc_' || c_custkey, {_DESCRIPTION}, CAST(1 AS INTEGER), 'attr',
 {sql_pick(_ATTRIBUTE_TYPE, "c_custkey % 8")}, {sql_pick(_ATTRIBUTE_NATIVE, "c_custkey % 8")}, true, false,
 c_custkey % 8 = 0, 'attr' FROM customer WHERE c_custkey % 5 <> 1 AND c_mktsegment <> 'BUILDING'""")
def dynamics_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions with attributes, with an empty reply, and with none at all."""
    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") != "BUILDING")
    body = F.when(key % 5 == 1, '{"value":[]}').otherwise(
        F.concat(
            F.lit('{"value":[{"LogicalName":"own_id","AttributeType":"Uniqueidentifier","IsPrimaryId":true,'
                  '"RequiredLevel":{"Value":"SystemRequired"},"DisplayName":{"UserLocalizedLabel":{"Label":"Own id"}}},'
                  '{"LogicalName":"attr","AttributeType":"'),
            pick(_ATTRIBUTE_NATIVE, key % 8), F.lit('","IsPrimaryId":false}]}'),
        )
    )
    replies = payload(customers, "crm", F.concat(F.lit("acc_"), key), key, body)
    found = dynamics.attribute_fields(_definitions(spark, sf_dir), replies)
    return found.select("entity", "entity_description", *_FIELD, "description")


@query("dynamics_attribute_pages", """
SELECT 'acc_' || c_custkey AS entity, CAST(f.k AS INTEGER) AS position, 'a' || f.k || '_' || c_custkey AS name,
 CASE WHEN f.k < 2 THEN 'integer' ELSE 'string' END AS type, f.k = 0 AS primary_key
FROM customer, (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11)) AS f(k) WHERE f.k < c_custkey % 13 AND c_custkey % 13 <> 5
UNION ALL SELECT 'acc_' || c_custkey, CAST(0 AS INTEGER), 'acc_id', 'uuid', true FROM customer WHERE c_custkey % 13 IN (0, 5)
UNION ALL SELECT 'acc_' || c_custkey, CAST(1 AS INTEGER), CASE c_custkey % 4 WHEN 0 THEN 'name' ELSE 'title' END, 'string', false
FROM customer WHERE c_custkey % 13 IN (0, 5)""")
def dynamics_attribute_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attribute a page and up to twelve pages an entity; pages of some entities are refused."""
    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    pages = customers.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11)))).where(F.col("k") < key % 13)
    body = F.concat(
        F.lit('{"value":[{"LogicalName":"a'), F.col("k"), F.lit("_"), key, F.lit('","AttributeType":"'),
        F.when(F.col("k") < 2, "Integer").otherwise("String"), F.lit('","IsPrimaryId":'), (F.col("k") == 0).cast("string"), F.lit("}]}"),
    )
    path = F.concat(F.lit("/attributes"), F.when(F.col("k") > 0, F.concat(F.lit(text.PAGE_MARK), F.col("k") + 1)).otherwise(""))
    status = F.when(key % 13 == 5, 500).otherwise(200)
    replies = payload(pages, "crm", F.concat(F.lit("acc_"), key), path, body, status)
    found = dynamics.attribute_fields(_definitions(spark, sf_dir), replies)
    return found.select("entity", "position", "name", "type", "primary_key")


@query("dynamics_choice", """
SELECT 'crm' || c_custkey AS source_id, 'acc' AS entity, 'acc_id' AS name FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT 'crm' || c_custkey, 'acc', 'name' FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT 'crm' || c_custkey, 'E' || c_custkey, f.name FROM customer,
 (VALUES ('id'), ('attr'), ('owner')) AS f(name) WHERE c_custkey % 2 = 1""")
def dynamics_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source has a metadata document; half of them also have definitions, which win."""
    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer")
    source = F.concat(F.lit("crm"), key)
    defined = F.when(
        key % 2 == 0, '{"value":[{"LogicalName":"acc","PrimaryIdAttribute":"acc_id"}]}'
    ).otherwise('{"value":[]}')
    xml = F.concat(F.lit(_EDMX_HEAD), _entity_xml("E", key, F.lit("Edm.Date"), F.lit("NS.X")), F.lit(_EDMX_TAIL))
    found = dynamics.choose_metadata(
        dynamics.definition_fields(payload(customers, source, F.lit(""), key, defined)),
        payload(customers, source, F.lit(""), key, xml),
    )
    return found.select("source_id", "entity", "name")


# ---- SAGE ----

_X3_NATIVE = ["A", "D", "DCB", "L", "Y", "QTY", "ZZ"]
_X3_TYPE = ["string", "date", "decimal", "integer", "boolean", "decimal", "string"]


@query("x3_fields", f"""
SELECT 'OBJ' || s_suppkey AS entity, 'SAGE X3 - SEED - OBJ' || s_suppkey AS entity_description,
 CAST(0 AS INTEGER) AS position, 'NUM' AS name, 'string' AS type, 'A' AS native_type, false AS nullable,
 true AS primary_key, false AS foreign_key, s_name AS description FROM supplier WHERE s_suppkey % 4 < 2
UNION ALL SELECT 'OBJ' || s_suppkey, 'SAGE X3 - SEED - OBJ' || s_suppkey, CAST(1 AS INTEGER), 'VAL',
 {sql_pick(_X3_TYPE, "s_suppkey % 7")}, {sql_pick(_X3_NATIVE, "s_suppkey % 7")}, true, false, s_suppkey % 2 = 0, ''
 FROM supplier WHERE s_suppkey % 4 < 2
UNION ALL SELECT 'OBJ' || s_suppkey, 'SAGE X3 - SEED - OBJ' || s_suppkey, f.position, f.name, f.type, f.native_type,
 f.nullable, f.primary_key, false, ''
 FROM supplier, (VALUES (CAST(0 AS INTEGER), 'ROWID', 'integer', 'L', false, true),
  (CAST(1 AS INTEGER), 'CODE', 'string', 'A', false, false),
  (CAST(2 AS INTEGER), 'DESCRIPTION', 'string', 'A', true, false))
  AS f(position, name, type, native_type, nullable, primary_key) WHERE s_suppkey % 4 = 2""")
def x3_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors, refused objects (basic fields) and unreadable replies (skipped)."""
    key = F.col("s_suppkey")
    body = F.when(key % 4 == 3, "{broken").otherwise(
        F.concat(
            F.lit('{"$fields":[{"$fieldName":"NUM","$isKey":true,"$description":"'), "s_name",
            F.lit('"},{"$fieldName":"VAL","$type":"'), pick(_X3_NATIVE, key % 7), F.lit('","$isForeignKey":'),
            (key % 2 == 0).cast("string"), F.lit("}]}"),
        )
    )
    landed = payload(
        table(spark, sf_dir, "supplier"), "x3", F.concat(F.lit("OBJ"), key), key, body
    ).withColumn("status", F.when(F.col("path").cast("bigint") % 4 == 2, 404).otherwise(200))
    return sage.x3_fields(landed).select("entity", "entity_description", *_FIELD, "description")


@query("cloud_fields", """
WITH rows AS (SELECT s_suppkey, 'res' || s_suppkey AS entity,
 'SAGE Business Cloud - res' || s_suppkey AS entity_description FROM supplier)
SELECT entity, entity_description, f.position, f.name, f.type, f.native_type, f.nullable, f.primary_key, f.foreign_key
FROM rows, (VALUES (CAST(0 AS INTEGER), 'id', 'string', 'str', true, true, false),
 (CAST(1 AS INTEGER), 'tax_id', 'integer', 'int', true, false, true),
 (CAST(2 AS INTEGER), 'paid_on', 'date', 'str', true, false, false),
 (CAST(3 AS INTEGER), 'note', 'string', 'NoneType', true, false, false),
 (CAST(4 AS INTEGER), 'balance', 'float', 'float', true, false, false))
 AS f(position, name, type, native_type, nullable, primary_key, foreign_key) WHERE s_suppkey % 4 < 2
UNION ALL SELECT entity, entity_description, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM rows WHERE s_suppkey % 4 = 2""")
def cloud_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples under `$items` or `value`, empty samples (no field), and refused resources (skipped)."""
    key = F.col("s_suppkey")
    record = F.concat(
        F.lit('{"id":"s'), key, F.lit('","tax_id":'), key, F.lit(',"paid_on":"2024-05-06","note":null,"balance":'),
        F.format_string("%.2f", "s_acctbal"), F.lit("}"),
    )
    body = (
        F.when(key % 4 == 0, F.concat(F.lit('{"$items":['), record, F.lit('],"value":[{"x":1}]}')))
        .when(key % 4 == 1, F.concat(F.lit('{"value":['), record, F.lit(',{"x":1}]}')))
        .otherwise('{"$items":[]}')
    )
    landed = payload(table(spark, sf_dir, "supplier"), "cloud", F.concat(F.lit("res"), key), key, body).withColumn(
        "status", F.when(F.col("path").cast("bigint") % 4 == 3, 403).otherwise(200)
    )
    return sage.cloud_fields(landed).select("entity", "entity_description", *_FIELD)


@query("cloud_fields_all", """
WITH rows AS (SELECT s_suppkey, 'res' || s_suppkey AS entity, 'SAGE Business Cloud - res' || s_suppkey AS entity_description FROM supplier)
SELECT entity, entity_description, f.position, f.name, f.type, f.native_type, f.nullable, f.primary_key, f.foreign_key
FROM rows, (VALUES (CAST(0 AS INTEGER), 'id', 'string', 'str', true, true, false), (CAST(1 AS INTEGER), 'note', 'date', 'str', true, false, false),
 (CAST(2 AS INTEGER), 'late_id', 'integer', 'int', true, false, true), (CAST(3 AS INTEGER), 'none', 'string', 'NoneType', true, false, false))
 AS f(position, name, type, native_type, nullable, primary_key, foreign_key) WHERE s_suppkey % 4 = 0
UNION ALL SELECT entity, entity_description, f.position, f.name, f.type, 'string', f.position = 1, f.position = 0, false
FROM rows, (VALUES (CAST(0 AS INTEGER), 'id', 'uuid'), (CAST(1 AS INTEGER), 'display_name', 'string')) AS f(position, name, type) WHERE s_suppkey % 4 = 1
UNION ALL SELECT entity, entity_description, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM rows WHERE s_suppkey % 4 = 2""")
def cloud_fields_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resources typed from all records: a key and a type that only later ones have, records that are no objects, no records, refused."""
    key = F.col("s_suppkey")
    rows = F.concat(F.lit('{"$items":["x",{"id":"s'), key, F.lit('","note":null},{"id":null,"late_id":'), key, F.lit(',"none":null,"note":"2024-05-06"}]}'))
    body = F.when(key % 4 == 0, rows).when(key % 4 == 1, '{"value":[1,"x"]}').otherwise('{"$items":[]}')
    status = F.when(key % 4 == 3, 403).otherwise(200)
    landed = payload(table(spark, sf_dir, "supplier"), "cloud", F.concat(F.lit("res"), key), key, body, status)
    return sage.cloud_fields(landed, mode="all").select("entity", "entity_description", *_FIELD)


# ---- SQL dictionary ----

_SQL_NATIVE = ["VARCHAR(255)", "NUMERIC(12, 2)", "double precision", "bigint", "TIMESTAMP", "money", "uuid"]
_SQL_TYPE = ["string", "decimal", "string", "integer", "datetime", "string", "uuid"]

_DICTIONARY_SQL = f"""
WITH cols AS (
 SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT 'T' || l_orderkey AS entity, l_linenumber AS position, 'c' || l_linenumber AS name,
 {sql_pick(_SQL_TYPE, "p % 7")} AS type, {sql_pick(_SQL_NATIVE, "p % 7")} AS native_type, p % 3 = 0 AS nullable,
 l_linenumber = 1 AS primary_key, o_orderstatus = 'F' AND l_linenumber IN (2, 3) AS foreign_key
FROM cols JOIN orders ON o_orderkey = l_orderkey"""


def _dictionary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as tables, their lines as columns."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    columns = lines.select(
        F.lit("db").alias("source_id"), F.concat(F.lit("T"), "l_orderkey").alias("table_name"),
        F.concat(F.lit("c"), "l_linenumber").alias("column_name"),
        pick(_SQL_NATIVE, F.col("p") % 7).alias("native_type"), (F.col("p") % 3 == 0).alias("nullable"),
        F.col("l_linenumber").alias("position"),
    )
    orders = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("T"), "o_orderkey")
    keys = orders.select(F.lit("db").alias("source_id"), name.alias("table_name"), F.lit("c1").alias("column_name"))
    references = orders.filter(F.col("o_orderstatus") == "F").select(
        F.lit("db").alias("source_id"), name.alias("table_name"),
        F.array(F.lit("c2"), F.lit("c3")).alias("constrained"),
        F.concat(F.lit("T"), "o_custkey").alias("referred_table"),
        F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("c1"))).otherwise(
            F.array(F.lit("c1"), F.lit("c2"))
        ).alias("referred"),
    )
    return columns, keys, references


@query("sql_dictionary", _DICTIONARY_SQL)
def sql_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.dictionary_fields(*_dictionary(spark, sf_dir)).select("entity", *_FIELD)


@query("fk_relations", """
WITH known AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)
SELECT 'T' || o_orderkey AS source_entity, 'T' || o_custkey AS target_entity, 'c2' AS source_field,
 'c1' AS target_field, 'many_to_one' AS relation_type
FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT k FROM known)
UNION ALL SELECT 'T' || o_orderkey, 'T' || o_custkey, 'c3', 'c2', 'many_to_one'
FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 1 AND o_custkey IN (SELECT k FROM known)""")
def fk_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns, _, references = _dictionary(spark, sf_dir)
    found = relations.fk_relations(references, columns)
    return found.drop("source_id")


@query("prefix_filter", """
SELECT * FROM (
 SELECT list_extract(['F_', 'p_', 'g_', 'E_', 'cbf_', 'X_', 'JM_', 'FACT'], CAST(p_partkey % 8 AS INTEGER) + 1)
  || p_partkey AS table_name FROM part)
WHERE regexp_matches(upper(table_name), '^(F_|P_|G_|E_|CBF_|JM_)')""")
def prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["F_", "p_", "g_", "E_", "cbf_", "X_", "JM_", "FACT"]
    tables = table(spark, sf_dir, "part").select(
        F.concat(pick(names, F.col("p_partkey") % 8), "p_partkey").alias("table_name")
    )
    return dictionary.prefix_filter(tables)


# ---- one scan over all dialects ----

_DIALECTS = [
    "rest", "odata", "sage_x3", "abap", "bapi", "dynamics_entities", "sage_cloud", "sql", "sage_100", "file", "sap_odata", "dynamics_edmx",
    "graphql", "file_json",
]


def _all_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload per order, of a dialect by its number; system of an order is its customer."""
    key = F.col("o_orderkey")
    xml = F.concat(F.lit(_EDMX_HEAD), _entity_xml("O", key, F.lit("Edm.Int32"), F.concat(F.lit("Collection(NS.C"), "o_custkey", F.lit(")"))), F.lit(_EDMX_TAIL))
    records = F.concat(F.lit('[{"id":'), key, F.lit(',"n":null},{"n":'), "o_totalprice", F.lit("}]"))
    tables = F.concat(
        F.lit('{"columns":[{"position":1,"name":"id","native_type":"BIGINT","nullable":false},{"position":2,"name":"ref","native_type":"BIGINT"}],'
              '"primary_key":["id"],"foreign_keys":[{"constrained":["ref"],"referred_table":"F_'), key + F.when(key % 28 < 14, 0).otherwise(1),
        F.lit('","referred":["id"]}]}'),
    )
    bodies = {
        "rest": records, "graphql": records, "file_json": records, "odata": xml, "sap_odata": xml, "dynamics_edmx": xml,
        "sage_x3": F.lit('{"$fields":[{"$fieldName":"N","$type":"D","$isKey":true},{"$fieldName":"M"}]}'),
        "abap": F.lit('{"FIELDS":[{"FIELDNAME":"F","DATATYPE":"DATS","KEYFLAG":"X"},{"FIELDNAME":"G"}]}'),
        "bapi": F.lit('{"PARAMS_AND_EXCPS":[{"PARAMETER":"P","TABNAME":"CURR"},{"PARAMETER":"Q"}]}'),
        "dynamics_entities": F.concat(F.lit('{"value":[{"LogicalName":"acc_'), key, F.lit('","PrimaryIdAttribute":"acc_id"}]}')),
        "sage_cloud": F.concat(F.lit('{"$items":'), records, F.lit("}")), "sql": tables, "sage_100": tables,
        "file": F.when(key % 28 < 14, F.concat(F.lit('{"rows":'), records, F.lit("}"))).otherwise("id,n"),
    }
    dialect = pick(_DIALECTS, key % len(_DIALECTS))
    body = F.lit(None).cast("string")
    for name, made in bodies.items():
        body = F.when(F.col("dialect") == name, made).otherwise(body)
    landed = table(spark, sf_dir, "orders").withColumn("dialect", dialect)
    source = F.concat(F.lit("s"), F.col("o_custkey"), F.lit("_"), "dialect")
    rows = payload(landed.withColumn("_source", source).withColumn("_body", body), F.col("_source"), F.concat(F.lit("F_"), key), key, F.col("_body"))
    return rows.withColumn("dialect", F.regexp_replace("source_id", "^s[0-9]+_", ""))


_MADE = f"""o AS (SELECT *, {sql_pick(_DIALECTS, f"o_orderkey % {len(_DIALECTS)}")} AS d FROM orders),
made AS (
 SELECT 's' || o_custkey || '_' || d AS source_id, CAST(o_orderkey AS VARCHAR) AS path, o_custkey, o_orderkey, d,
  CASE WHEN d IN ('odata', 'sap_odata', 'dynamics_edmx') THEN 'O' || o_orderkey WHEN d = 'dynamics_entities' THEN 'acc_' || o_orderkey
   ELSE 'F_' || o_orderkey END AS entity
 FROM o WHERE NOT (d = 'file' AND o_orderkey % 28 >= 14))"""
_ALL = [
    ("'rest','graphql','file_json','file','sage_cloud'", [("id", "integer"), ("n", "float")]),
    ("'odata','sap_odata','dynamics_edmx'", [("id", "integer"), ("attr", "integer"), ("owner", "relation")]),
    ("'sage_x3'", [("N", "date"), ("M", "string")]), ("'abap'", [("F", "date"), ("G", "string")]), ("'bapi'", [("P", "decimal"), ("Q", "string")]),
    ("'dynamics_entities'", [("acc_id", "uuid"), ("name", "string")]), ("'sql','sage_100'", [("id", "integer"), ("ref", "integer")]),
]


@query("discover_all", f"WITH {_MADE}" + "\nUNION ALL\n".join(
    f"SELECT source_id, path, entity, CAST({i} AS INTEGER) AS position, '{n}' AS name, '{t}' AS type FROM made WHERE d IN ({d})"
    for d, own in _ALL for i, (n, t) in enumerate(own)
).join(["\n", ""]))
def discover_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of fourteen dialects in one table, discovered in one scan."""
    found = dispatch.discover_all(_all_dialects(spark, sf_dir)).fields
    return found.select("source_id", "path", "entity", "position", "name", "type")


@query("discover_all_summary", f"""WITH {_MADE},
counts AS (
 SELECT source_id, count(*) AS entity_count,
  sum(CASE WHEN d IN ('odata', 'sap_odata', 'dynamics_edmx') THEN 3 ELSE 2 END) AS field_count,
  sum(CASE WHEN d IN ('odata', 'sap_odata', 'dynamics_edmx') THEN 1 WHEN d IN ('sql', 'sage_100') AND o_orderkey % 28 < 14 THEN 1 ELSE 0 END) AS relation_count
 FROM made GROUP BY source_id)
SELECT source_id, entity_count, CAST(field_count AS BIGINT) AS field_count, CAST(relation_count AS BIGINT) AS relation_count,
 format('{{}} entites, {{}} champs synchronises', entity_count, CAST(field_count AS BIGINT)) AS message FROM counts""")
def discover_all_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, fields and relations per source; half of the foreign keys refer to a table that is not listed."""
    return dispatch.discover_all(_all_dialects(spark, sf_dir)).summary()


# ---- types ----

# (dialect, variant, native name, expected universal type)
_CASES = [
    ("sql", "live", "VARCHAR(255)", "string"), ("sql", "live", "NUMERIC(12, 2)", "decimal"),
    ("sql", "live", "DOUBLE PRECISION", "string"), ("sql", "live", "integer", "integer"),
    ("sql", "live", "REAL", "float"), ("sql", "lib", "REAL", "string"), ("sql", "lib", "blob", "binary"),
    ("sql", "live", "TINYINT", "string"), ("sql", "live", "DATETIME2", "string"), ("sql", "live", " jsonb ", "json"),
    ("sql", "sage100", "TinyInt", "integer"), ("sql", "sage100", "BIT", "boolean"),
    ("sql", "sage100", "money(10)", "decimal"), ("edm", "live", "Edm.Byte", "integer"),
    ("edm", "lib", "Edm.Byte", "string"), ("edm", "live", "Edm.Binary", "string"),
    ("edm", "lib", "Edm.Binary", "binary"), ("edm", "lib", "Edm.TimeOfDay", "time"),
    ("edm", "live", "edm.string", "string"), ("edm", "live", "Edm.SByte", "string"),
    ("dynamics", "live", "Lookup", "uuid"), ("dynamics", "live", "STATE", "integer"),
    ("abap", "live", "INT8", "string"), ("abap", "lib", "INT8", "integer"), ("abap", "live", "curr", "string"),
    ("sage_x3", "live", "DCB", "decimal"), ("sage_x3", "live", "y", "string"),
]
_CASE_VALUES = ", ".join(f"({i}, '{d}', '{v}', '{n}', '{t}')" for i, (d, v, n, t) in enumerate(_CASES))


@query("normalize_types", f"""
SELECT p_partkey, dialect, variant, native_type, type
FROM part JOIN (VALUES {_CASE_VALUES}) AS c(i, dialect, variant, native_type, type) ON p_partkey % {len(_CASES)} = i""")
def normalize_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("p_partkey") % len(_CASES)
    natives = table(spark, sf_dir, "part").select(
        "p_partkey", pick([c[0] for c in _CASES], i).alias("dialect"), pick([c[1] for c in _CASES], i).alias("variant"),
        pick([c[2] for c in _CASES], i).alias("native_type"),
    )
    return types.normalize_types(natives).select("p_partkey", "dialect", "variant", "native_type", "type")


# ---- saving and relations ----


@query("field_dedup", """
SELECT user_id, event_type AS name, min(event_id) AS position, arg_max(value, event_id) AS value,
 arg_max(props, event_id) AS props FROM events GROUP BY user_id, event_type""")
def field_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(
        "user_id", F.col("event_type").alias("name"), F.col("event_id").alias("position"), "value", "props"
    )
    return fields.dedup_fields(log, ["user_id", "name"], "position", ["value", "props"])


@query("sync_summary", """
SELECT CAST(o_custkey AS VARCHAR) AS source_id, count(DISTINCT o_orderkey) AS entity_count,
 count(l_orderkey) AS field_count, CAST(0 AS BIGINT) AS relation_count,
 format('{} entites, {} champs synchronises', count(DISTINCT o_orderkey), count(l_orderkey)) AS message
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sources, orders as entities, lines as fields."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    found = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_custkey").cast("string").alias("source_id"), F.lit("").alias("path"), F.lit(0).alias("entity_no"),
        F.col("o_orderkey").cast("string").alias("entity"), F.col("l_linenumber").alias("position"),
    )
    return fields.sync_summary(found)


_STAR_KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
    "part": "p_partkey", "orders": "o_orderkey",
}
_PAIRS = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
]


@query("relation_confidence", "\nUNION ALL\n".join(f"""
SELECT '{s}' AS source_entity, '{c}' AS source_field, '{t}' AS target_entity, '{k}' AS target_field,
 'many_to_one' AS relation_type, count(DISTINCT {c}) AS n_values,
 count(DISTINCT {c}) FILTER ({c} IN (SELECT {k} FROM {t})) AS n_found,
 CAST(count(DISTINCT {c}) FILTER ({c} IN (SELECT {k} FROM {t})) AS DOUBLE) / count(DISTINCT {c}) AS confidence,
 false AS is_confirmed FROM {s}""" for s, c, t, k in _PAIRS))
def relation_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: table(spark, sf_dir, t) for t in [*_STAR_KEYS, "lineitem"]}
    return relations.relation_confidence(tables, _STAR_KEYS)
