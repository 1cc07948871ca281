"""Compare a Spark result with the rows DuckDB gives for its SQL."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb

TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "float": "FLOAT", "date": "DATE"}


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def differences(df, con, sql: str) -> list[str]:
    """Empty when columns, types and rows agree."""
    names = sorted(df.columns)
    cursor = con.execute(sql)
    types = {d[0]: str(d[1]) for d in cursor.description}
    if sorted(types) != names:
        return [f"columns {names} against {sorted(types)}"]
    found = []
    for f in df.schema.fields:
        want = TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
        if types[f.name] != want and not (types[f.name] == '"NULL"'):
            found.append(f"type of {f.name}: {want} against {types[f.name]}")
    order = [d[0] for d in cursor.description]
    at = [order.index(n) for n in names]
    theirs = Counter(tuple(_cell(row[i]) for i in at) for row in cursor.fetchall())
    ours = Counter(tuple(_cell(row[n]) for n in names) for row in df.select(*names).collect())
    if ours != theirs:
        extra, missing = ours - theirs, theirs - ours
        found.append(f"{sum(ours.values())} rows against {sum(theirs.values())}; "
                     f"only ours {sum(extra.values())} {list(extra)[:3]}; only sql {list(missing)[:3]}")
    return found
