"""Schemas of the observation families, and the catalogue of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE = "struct<left:int,right:int>"
#: One table for each family. Views are named kind.name; a fact that isn't known is null or its status says so.
SCHEMAS = {
    "views": "view string, kind string, complete boolean, tainted_scopes array<string>",
    "components": "view string, kind string, native_name string, ordinal int, status string, source string, line int, column int",
    "ports": f"view string, kind string, component string, native_name string, ordinal int, direction string, role string, status string, field_states map<string,string>, width int, left int, right int, packed array<{RANGE}>, unpacked array<{RANGE}>, bit_indices array<int>, explicit_scalar boolean, bit_order_known boolean, die_pad string, physical boolean, source string, line int, column int",
    "pin_mappings": "view string, kind string, die_pad string, package_ball string, signal string, component string, line int",
    "objects": "view string, kind string, object_kind string, relation string, native_name string, scope string, match_mode string, nocase boolean, is_update boolean, ordinal int",
    "clocks": "view string, kind string, native_name string, targets array<string>, period double, waveform array<double>, source string, generated boolean",
    "interfaces": "view string, kind string, component string, native_name string, port_maps map<string,string>, allow_many_to_one boolean",
    "registers": "view string, kind string, native_name string, component string, memory_map string, address_block string, register_files array<string>, address_offset decimal(38,0), absolute_address decimal(38,0), size_bits int, access string, status string, ordinal int, fields array<struct<name:string,bit_offset:int,bit_width:int,access:string,reset:decimal(38,0),status:string>>",
    "functions": "view string, kind string, component string, output string, expression string",
    "endpoints": "view string, native_name string, bit_index int, ordinal int, width int, status string",
    "edges": "view string, source string, sink string, edge_kind string, inverted boolean, status string",
    "requirements": "id string, source string, sink string, expectation string, transform string, through array<string>, exclude array<string>, ordinal int",
    "aliases": "alias_kind string, view_selector string, component string, native string, canonical string",
    "participation": "entity_pattern string, required array<string>, optional array<string>",
    "waivers": "waiver_index int, code string, object_pattern string, property_pattern string, fingerprint string, views array<string>, reason string, expires date",
    "overrides": "code string, severity string",
    "parser_diagnostics": "code string, view string, scope string, message string, source string, line int, column int",
    "contract_ports": "component string, port string, direction string, role string, width int",
}
EVIDENCE = "array<struct<view:string,value:string,source:string,line:int,column:int>>"
FINDING = f"code string, object_kind string, object_id string, property string, message string, evidence {EVIDENCE}"

# Code, name and default severity of every rule.
RULES = """
OC1001 invalid-configuration fatal
OC1002 source-not-found fatal
OC1003 source-glob-empty fatal
OC1004 waiver-expired warning
OC1005 waiver-unmatched info
OC1101 parse-error fatal
OC1102 unsupported-construct warning
OC1103 unresolved-expression warning
OC1104 analysis-scope-tainted warning
OC1105 check-not-applicable info
OC2001 component-unassociated warning
OC2002 alias-collision fatal
OC2003 duplicate-definition error
OC2004 duplicate-definition-conflict error
OC2005 ambiguous-name-normalization error
OC3001 component-missing-from-view error
OC3002 component-not-in-contract error
OC3101 pin-missing-from-view error
OC3102 pin-not-in-contract error
OC3103 duplicate-pin error
OC3104 likely-pin-name-mismatch warning
OC4001 direction-mismatch error
OC4002 unsupported-direction warning
OC4101 width-mismatch error
OC4102 range-order-mismatch error
OC4103 dimension-shape-mismatch error
OC4104 bus-bit-gap error
OC4105 duplicate-bus-bit error
OC4106 scalar-vector-mismatch warning
OC4201 role-mismatch error
OC4202 power-ground-pin-missing error
OC4203 power-ground-polarity-mismatch error
OC4204 clock-reset-role-mismatch error
OC4301 boolean-function-mismatch error
OC4302 boolean-function-uncheckable warning
OC4303 liberty-function-references-unknown-pin error
OC5001 unknown-die-pad error
OC5002 unknown-package-signal error
OC5003 duplicate-package-ball error
OC5004 die-pad-mapped-multiple-times error
OC5005 conflicting-package-signal error
OC5006 invalid-pin-map-row error
OC6001 sdc-object-not-found error
OC6002 clock-definition-mismatch error
OC6003 clock-target-role-mismatch error
OC6101 upf-instance-not-found error
OC6102 upf-port-not-found error
OC6103 upf-object-not-found error
OC6104 duplicate-upf-object error
OC6201 ipxact-interface-port-not-found error
OC6202 ipxact-interface-port-map-conflict error
OC6301 register-missing-from-view error
OC6302 register-address-mismatch error
OC6303 register-width-mismatch error
OC6304 register-field-missing-from-view error
OC6305 register-field-layout-mismatch error
OC6306 register-access-mismatch error
OC6307 duplicate-register-definition error
OC6308 register-field-reset-mismatch error
OC6309 invalid-register-field-layout error
OC6310 ambiguous-register-identity error
OC6401 def-object-not-found error
OC6501 connectivity-endpoint-not-found error
OC6502 connectivity-endpoint-ambiguous error
OC6503 required-connectivity-missing error
OC6504 forbidden-connectivity-present error
OC6505 connectivity-inconclusive warning
OC6506 connectivity-width-mismatch error
OC6507 connectivity-bit-mapping-mismatch error
OC6508 connectivity-polarity-mismatch error
OC6509 contradictory-connectivity-requirement error
OC9001 parser-plugin-failure fatal
OC9002 checker-plugin-failure fatal
OC9999 internal-error fatal
"""
CATALOG = {c: (n, s) for c, n, s in (line.split() for line in RULES.split("\n") if line)}
SEVERITIES = ("fatal", "error", "warning", "info")


def empty(spark: SparkSession, family: str) -> DataFrame:
    """A family without rows."""
    return without_rows(spark, SCHEMAS[family])


def without_rows(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table that the optimizer knows to be empty: joins with it are decided as they are planned."""
    return spark.range(0).select(F.from_json(F.lit("{}"), schema).alias("x")).where("false").select("x.*")


def catalog(spark: SparkSession) -> DataFrame:
    """(code, rule, severity, rank) of every rule."""
    return spark.createDataFrame([(c, n, s, SEVERITIES.index(s)) for c, (n, s) in CATALOG.items()], "code string, rule string, severity string, rank int")
