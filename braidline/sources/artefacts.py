"""Integration interfaces as files, and read back: the interface's node, a flow with its signature, adapters, documents.

An interface's steps (see ``operators.pipelines``) are written as a tree of files: ``node.idf``, ``srvc/main/flow.xml``
and ``node.ndf``, ``adpt/<adapter>/node.ndf`` and ``docs/<document>/node.ndf``. What an adapter reads or writes stands in
its blob alone, in the record format of ``records``. ``read_interface`` gives the steps again, so that lineage can be
found from the files.
"""

from __future__ import annotations

import base64
import json
import re
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .records import decode, encode

#: Template names, letters of adapter names, service names and types of the format.
TEMPLATES = {"select": ("Select", "S"), "insert": ("Insert", "I"), "update": ("Update", "U"), "sql": ("CustomSQL", "X")}
VALUES_CLASS, RECORDS_CLASS = "com.wm.util.Values", "[Lcom.wm.util.Values;"
CLEAR = "pub.flow:clearPipeline"
STRING_FIELD, RECORD_FIELD = "0", "2"


# -- adapters -----------------------------------------------------------------------------------------------------------


def owners(columns: list[str], home: str) -> dict[str, str]:
    """Which table each column (TABLE.COLUMN, or a bare name of the home table) belongs to."""
    return {c: c.rpartition(".")[0] or home for c in columns}


def adapter_record(step: dict) -> dict:
    """The record that binds an adapter to its connection, table and columns."""
    kind = step["op"]
    table = step.get("table") or next(iter(owners(list(step["fields"].values()), "").values()), "")
    schema, _, name = table.rpartition(".")
    record: dict = {"serviceTemplateName": f"com.wm.adapter.wmjdbc.services.{TEMPLATES[kind][0]}", "adapterTypeName": "JDBCAdapter", "connectionName": f"conn:{schema}", "tables.schemaName": schema, "tables.realSchemaName": schema, "tables.tableName": name}
    if kind == "select":
        fields = step["fields"]
        owner = owners(list(fields.values()), table)
        record |= {"select.outputField": list(fields), "select.refColumn": [c.rpartition(".")[2] for c in fields.values()], "select.refTable": [owner[c] for c in fields.values()], "select.maxRows": 0}
        if step.get("where"):
            record |= {"select.whereColumn": [c.rpartition(".")[2] for c in step["where"]], "select.whereTable": [owners([c], table)[c] for c in step["where"]]}
    elif kind == "sql":
        record |= {"customSQL.sql": step["text"]}
    else:
        columns = step["columns"]
        record |= {"update.column": list(columns), "update.inputField": [v["path"] for v in columns.values()], "update.expression": [v.get("expr", "?") for v in columns.values()], "update.batchSize": 1000}
        if step.get("where"):
            record["update.whereColumn"] = list(step["where"])
    return record


def adapter_step(record: dict) -> dict:
    """The step that an adapter's record stands for."""
    kind = next(k for k, (name, _) in TEMPLATES.items() if record["serviceTemplateName"].endswith("." + name))
    table = ".".join(p for p in (record["tables.schemaName"], record["tables.tableName"]) if p)
    if kind == "select":
        step = {"op": kind, "fields": {f: f"{t}.{c}" for f, t, c in zip(record["select.outputField"], record["select.refTable"], record["select.refColumn"], strict=True)}}
        if "select.whereColumn" in record:
            step["where"] = [f"{t}.{c}" for t, c in zip(record["select.whereTable"], record["select.whereColumn"], strict=True)]
        return step
    if kind == "sql":
        return {"op": kind, "table": table, "text": record["customSQL.sql"]}
    columns = zip(record["update.column"], record["update.inputField"], record["update.expression"], strict=True)
    step = {"op": kind, "table": table, "columns": {c: {"path": p} if e == "?" else {"path": p, "expr": e} for c, p, e in columns}}
    return step | ({"where": record["update.whereColumn"]} if "update.whereColumn" in record else {})


# -- trees --------------------------------------------------------------------------------------------------------------


def _text(root: ET.Element) -> str:
    ET.indent(root)
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root, encoding="unicode") + "\n"


def _node(**values: str) -> ET.Element:
    root = ET.Element("Values", version="2.0")
    for name, value in values.items():
        ET.SubElement(root, "value", name=name).text = value
    return root


def _fields(parent: ET.Element, names: list[str]) -> ET.Element:
    listed = ET.SubElement(parent, "array", name="rec_fields", depth="1", type="record", javaclass=RECORDS_CLASS)
    for n in names:
        one = ET.SubElement(listed, "record", javaclass=VALUES_CLASS)
        for key, value in (("field_name", n), ("field_type", STRING_FIELD), ("field_dim", "0"), ("field_opt", "true")):
            ET.SubElement(one, "value", name=key).text = value
    return listed


def _signature(root: ET.Element, takes: list[str], gives: list[str]) -> ET.Element:
    sig = ET.SubElement(root, "record", name="sig", javaclass=VALUES_CLASS)
    for side, names in (("in", takes), ("out", gives)):
        _fields(ET.SubElement(sig, "record", name=side, javaclass=VALUES_CLASS), names)
    return root


def document_node(namespace: str, fields: list[str]) -> ET.Element:
    """A document type: a list of rows with these fields."""
    root = _node(node_type="record", node_nsName=namespace, is_public="true")
    rows = _fields(root, ["results"])[0]
    rows[1].text, rows[2].text = RECORD_FIELD, "1"
    _fields(rows, fields)
    return root


def slot(path: str) -> str:
    """``a/b`` as the flow spells it: each part with its type and dimension, a record but for the last."""
    parts = path.split("/")
    return "".join(f"/{p};{1 if n + 1 == len(parts) else 2};0" for n, p in enumerate(parts))


def unslot(text: str) -> str:
    return "/".join(p.split(";")[0] for p in text.strip("/").split("/"))


class Writer:
    """Builds a flow's tree; adapters are named as they come."""

    def __init__(self, namespace: str):
        self.namespace, self.adapters = namespace, {}

    def adapter(self, step: dict) -> str:
        record = adapter_record(step)
        name = f"{record['tables.tableName']}_{TEMPLATES[step['op']][1]}"
        number = 1 + sum(n.rpartition("_")[0] == name for n in self.adapters)
        self.adapters[f"{name}_{number:02d}"] = (step, record)
        return f"{name}_{number:02d}"

    def steps(self, parent: ET.Element, items: list[dict]) -> None:
        for s in items:
            getattr(self, f"do_{s['op']}", self.do_adapter)(parent, s)

    def do_adapter(self, parent: ET.Element, s: dict) -> None:
        ET.SubElement(parent, "INVOKE", {"SERVICE": f"{self.namespace}.adpt:{self.adapter(s)}", "TIMEOUT": "", "VALIDATE-IN": "$none", "VALIDATE-OUT": "$none"})

    def _map(self, parent: ET.Element) -> ET.Element:
        return parent if parent.tag == "MAP" else ET.SubElement(parent, "MAP", MODE="STANDALONE")

    def do_copy(self, parent: ET.Element, s: dict) -> None:
        ET.SubElement(self._map(parent), "MAPCOPY", FROM=slot(s["from"]), TO=slot(s["to"]))

    def do_set(self, parent: ET.Element, s: dict) -> None:
        field = ET.SubElement(self._map(parent), "MAPSET", FIELD=slot(s["to"]))
        ET.SubElement(field, "VALUE", NAME=s["to"].rpartition("/")[2]).text = str(s["value"])

    def do_delete(self, parent: ET.Element, s: dict) -> None:
        ET.SubElement(self._map(parent), "MAPDELETE", FIELD=slot(s["path"]))

    def do_clear(self, parent: ET.Element, s: dict) -> None:
        call = ET.SubElement(parent, "INVOKE", {"SERVICE": CLEAR, "TIMEOUT": "", "VALIDATE-IN": "$none", "VALIDATE-OUT": "$none"})
        kept = ET.SubElement(ET.SubElement(call, "MAP", MODE="INPUT"), "MAPSET", FIELD="/preserve;1;1")
        for name in s.get("preserve", []):
            ET.SubElement(kept, "VALUE", NAME="preserve").text = name

    def do_invoke(self, parent: ET.Element, s: dict) -> None:
        call = ET.SubElement(self._map(parent), "MAPINVOKE", {"SERVICE": s["service"], "TIMEOUT": "", "VALIDATE-IN": "$none", "VALIDATE-OUT": "$none"})
        takes = ET.SubElement(call, "MAP", MODE="INPUT")
        for n, path in enumerate(s["inputs"]):
            ET.SubElement(takes, "MAPCOPY", FROM=slot(path), TO=slot(f"in{n}"))
        ET.SubElement(ET.SubElement(call, "MAP", MODE="OUTPUT"), "MAPCOPY", FROM=slot("value"), TO=slot(s["output"]))

    def do_loop(self, parent: ET.Element, s: dict) -> None:
        self.steps(ET.SubElement(parent, "LOOP", {"IN-ARRAY": slot(s.get("over", "results"))}), s["steps"])

    def do_sequence(self, parent: ET.Element, s: dict) -> None:
        self.steps(ET.SubElement(parent, "SEQUENCE", {"NAME": s.get("name", ""), "EXIT-ON": "FAILURE"}), s["steps"])

    def do_map(self, parent: ET.Element, s: dict) -> None:
        self.steps(ET.SubElement(parent, "MAP", MODE="STANDALONE"), s["steps"])

    def do_branch(self, parent: ET.Element, s: dict) -> None:
        branch = ET.SubElement(parent, "BRANCH", SWITCH=slot(s["on"]) if "on" in s else "")
        for n, case in enumerate(s["cases"]):
            self.steps(ET.SubElement(branch, "SEQUENCE", {"NAME": f"case{n}", "EXIT-ON": "FAILURE"}), case)


def write_interface(name: str, steps: list[dict], title: str = "") -> dict[str, str]:
    """Path and text of each file of an interface."""
    space = f"if.{name}"
    made = Writer(space)
    flow = ET.Element("FLOW", VERSION="3.0", CLEANUP="true")
    made.steps(flow, steps)
    files = {"node.idf": _node(node_type="interface", node_pkg=name, node_nsName=space, node_comment=title, is_public="true"), "srvc/main/flow.xml": flow, "srvc/main/node.ndf": _signature(_node(node_type="service", svc_type="flow", svc_subtype="unknown", node_nsName=f"{space}.srvc:main", is_public="true"), ["baseYmd"], ["dataCount"])}
    for adapter, (step, record) in made.adapters.items():
        takes = record.get("update.inputField") or record.get("select.whereColumn") or []
        gives = record.get("select.outputField") or ["updateCount"]
        node = _node(node_type="adapterService", svc_type="adapterService", adapterTypeName="JDBCAdapter", adapterServiceTemplateName=record["serviceTemplateName"], node_nsName=f"{space}.adpt:{adapter}", IRTNODE_PROPERTY=base64.b64encode(encode(record)).decode())
        files[f"adpt/{adapter}/node.ndf"] = _signature(node, takes, gives)
        fields = list(dict.fromkeys(f.rpartition("/")[2] for f in (gives if step["op"] == "select" else takes)))
        if fields:
            files[f"docs/{adapter}_DOC/node.ndf"] = document_node(f"{space}.docs:{adapter}_DOC", fields)
    return {path: _text(root) for path, root in files.items()}


def read_interface(files: dict[str, str]) -> list[dict]:
    """The steps of an interface from its files."""
    records = {}
    for path, text in files.items():
        if m := re.fullmatch(r"adpt/([^/]+)/node\.ndf", path):
            blob = next(v.text for v in ET.fromstring(text.encode()).iter("value") if v.get("name") == "IRTNODE_PROPERTY")
            records[m[1]] = decode(base64.b64decode("".join(blob.split())))[0]

    def inside(node: ET.Element) -> list[dict]:
        return [s for child in node for s in one(child)]

    def one(node: ET.Element) -> list[dict]:
        tag, service = node.tag, node.get("SERVICE", "")
        if tag == "INVOKE" and service == CLEAR:
            return [{"op": "clear", "preserve": [v.text for v in node.iter("VALUE")]}]
        if tag == "INVOKE":
            return [adapter_step(records[service.rpartition(":")[2]])]
        if tag == "MAPCOPY":
            return [{"op": "copy", "from": unslot(node.get("FROM")), "to": unslot(node.get("TO"))}]
        if tag == "MAPSET":
            return [{"op": "set", "to": unslot(node.get("FIELD")), "value": node.find("VALUE").text or ""}]
        if tag == "MAPDELETE":
            return [{"op": "delete", "path": unslot(node.get("FIELD"))}]
        if tag == "MAPINVOKE":
            return [{"op": "invoke", "service": service, "inputs": [unslot(c.get("FROM")) for c in node.findall("MAP[@MODE='INPUT']/MAPCOPY")], "output": unslot(node.find("MAP[@MODE='OUTPUT']/MAPCOPY").get("TO"))}]
        if tag == "LOOP":
            return [{"op": "loop", "over": unslot(node.get("IN-ARRAY")), "steps": inside(node)}]
        if tag == "BRANCH":
            return [{"op": "branch", "cases": [inside(c) for c in node]} | ({"on": unslot(node.get("SWITCH"))} if node.get("SWITCH") else {})]
        if tag == "SEQUENCE":
            return [{"op": "sequence", "name": node.get("NAME"), "steps": inside(node)}]
        return inside(node)  # MAP: its children stand for themselves

    return inside(ET.fromstring(files["srvc/main/flow.xml"].encode()))


def artefacts(interfaces: DataFrame) -> DataFrame:
    """(interface, path, text) of (interface, steps): a row for each file."""

    def run(batches):
        for batch in batches:
            rows = [(name, path, text) for name, steps in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for path, text in write_interface(name, json.loads(steps)).items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*rows, strict=True)], ["interface", "path", "text"])

    return interfaces.selectExpr("cast(interface as string) interface", "steps").mapInArrow(run, "interface string, path string, text string")


def interfaces_of(files: DataFrame) -> DataFrame:
    """(interface, steps) of (interface, path, text): what ``operators.pipelines.evaluate`` takes."""
    grouped = files.groupBy("interface").agg(F.map_from_entries(F.collect_list(F.struct("path", "text"))).alias("files"))

    def run(batches):
        for batch in batches:
            made = [json.dumps(read_interface(dict(f)), ensure_ascii=False) for f in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["interface", "steps"])

    return grouped.mapInArrow(run, "interface string, steps string")
