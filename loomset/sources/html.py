"""A page that shows a database's relations and references."""

from __future__ import annotations

import html
import json

from ..model import Database

_STYLE = "body{font-family:sans-serif} table{border-collapse:collapse;margin:1em 0} td,th{border:1px solid #999;padding:.2em .6em;text-align:left}"


def schema_data(database: Database, sizes: bool = False) -> dict:
    """Nodes and edges in a fixed order; ``sizes`` counts every relation."""
    nodes = []
    for name, relation in sorted(database.bound().items()):
        node = {"name": name, "key": list(relation.key), "attributes": [[f.name, f.dataType.simpleString()] for f in relation.df.schema.fields], "computed": sorted(relation.computed)}
        nodes.append(node | ({"size": len(relation)} if sizes else {}))
    edges = sorted([r.source, r.ref_key, r.target] for r in database.references)
    return {"nodes": nodes, "edges": edges}


def schema_graph(database: Database, sizes: bool = False) -> str:
    """A self-contained page: one table for each relation, a list of references, and the same data as JSON for scripts."""
    data, e = schema_data(database, sizes), html.escape
    parts = [f"<!doctype html><meta charset='utf-8'><title>{e(database.name or 'database')}</title><style>{_STYLE}</style>"]
    for node in data["nodes"]:
        size = f" ({node['size']})" if sizes else ""
        rows = "".join(f"<tr><td>{e(n)}</td><td>{e(t)}</td><td>{'key' if n in node['key'] else ''}</td></tr>" for n, t in node["attributes"])
        rows += "".join(f"<tr><td>{e(n)}</td><td></td><td>computed</td></tr>" for n in node["computed"])
        parts.append(f"<table id='{e(node['name'], quote=True)}'><caption>{e(node['name'])}{size}</caption>{rows}</table>")
    parts.append("<ul>" + "".join(f"<li>{e(s)}.{e(r)} &rarr; {e(t)}</li>" for s, r, t in data["edges"]) + "</ul>")
    safe = json.dumps(data, sort_keys=True).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
    parts.append(f"<script type='application/json' id='schema'>{safe}</script>")
    return "\n".join(parts)
