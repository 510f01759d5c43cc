"""Queries over the given tables, one for each operator, with the same operator's DuckDB text as oracle.

``VIEWS`` makes the operators' inputs out of the tables; a query names an operator and its parameters.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from partita.functions import text, theory
from partita.operators import DUCK, Operator, basics, joins, mining, stats, transforms, vectors, windows

VIEWS = {
    "notes": """select l_orderkey as seq_id, cast(l_quantity as int) as dur, cast(l_suppkey % 16 as int) as channel, cast(l_partkey % 128 as int) as pitch, 1 + (l_linenumber * 16) % 127 as velocity, l_linenumber as onset,
 row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) as pos from {lineitem}""",
    "events": "select seq_id, pos, case (pitch + pos) % 3 when 0 then 'patch_change' when 1 then 'note' else 'note_on' end as kind from {notes}",
    "states": "select seq_id, pos, onset as time, case channel % 3 when 0 then 'tempo' when 1 then 'chord' else 'patch' end as kind, channel, pitch % 3 as value from {notes}",
    "beats": "select seq_id, t as time from (select distinct seq_id from {notes}) s cross join (select 0 as t union all select 2 union all select 5 union all select 9) b",
    "pedals": "select seq_id, onset + 1 as time, max(case when pitch % 2 = 0 then 127 else 0 end) as value from {notes} group by seq_id, onset",
    "sections": "select seq_id, channel as section, 1 + cast(count(*) % 3 as int) as times from {notes} group by seq_id, channel",
    "roll": "select distinct seq_id, onset as frame, pitch % 12 as pitch from {notes}",
    "frames": "select seq_id, channel % 2 as channel, onset as frame, pitch from {notes}",
    "scored": "select cast((doc_id * 7919) % 1000 as double) / 1000 as score, quality as label from {labels}",
    "docs": "select doc_id, text, lang, source from {documents}",
    "items": "select item_id, text from {benchmark}",
    "vectors": "select vec_id, embedding, label from {embeddings}",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    body = VIEWS[name]
    return spark.sql(body, **{n: view(spark, sf_dir, n) for n in re.findall(r"\{([a-z]\w*)\}", body)})


def _with(names: list[str], done: list[str]) -> list[str]:
    for n in names:
        if n in VIEWS and n not in done:
            _with(re.findall(r"\{([a-z]\w*)\}", VIEWS[n]), done)
            done.append(n)
    return done


def oracle(op: Operator, **parameters) -> str:
    """The operator's DuckDB text over the tables."""
    body = op.text(DUCK, **parameters)
    plain = lambda t: re.sub(r"\{([a-z]\w*)\}", r"\1", t)
    views = ", ".join(f"{n} as ({plain(VIEWS[n])})" for n in _with(list(dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", body))), []))
    body = plain(body)
    return f"with {views}, {body[5:]}" if body.startswith("with ") else f"with {views} {body}"


def _all(module, *skip: str) -> dict[str, tuple[Operator, dict]]:
    return {name: (op, {}) for name, op in vars(module).items() if isinstance(op, Operator) and op.build.__module__ == module.__name__ and name not in skip}


ENTRIES: dict[str, tuple[Operator, dict]] = {
    **_all(transforms), **_all(stats), **_all(windows), **_all(joins), **_all(mining), **_all(vectors), **_all(theory), **_all(text), **_all(basics),
    "reverse_pitches": (transforms.reverse_melody, {"full": False}),
    "replace_loud": (transforms.replace_values, {"above": True}),
    "adjust_times_strict": (transforms.adjust_times, {"function": "greatest(t, 10.0)", "least": None}),
    "flipped_notes": (transforms.selected_notes, {"channel": 16, "flipped": 1, "transposed": 2}),
    "chords_of_several": (windows.chords, {"single": False, "last": False}),
    "hop_split_outside": (windows.hop_split, {"skip_inside": True}),
    "fixed_length_left": (windows.fixed_length, {"from_left": True}),
    "minkowski_largest": (vectors.minkowski_to, {"p": float("inf")}),
    "cosine_distances": (vectors.cosine_to, {"distance": True}),
    "vectors_to_range": (vectors.column_ranges, {"kind": "range", "top": 2.0}),
    "vectors_robust": (vectors.column_ranges, {"kind": "robust"}),
    "histogram_by_velocity": (stats.pitch_class_histogram, {"by_duration": False, "normalised": False}),
    "patterns_of_three": (mining.pattern_support, {"length": 3, "least": 0.0002}),
}


def run(name: str):
    op, parameters = ENTRIES[name]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(*(view(spark, sf_dir, n) for n in op.inputs(**parameters)), **parameters)

    return query


QUERIES = {name: run(name) for name in ENTRIES}
ORACLE = {name: oracle(op, **parameters) for name, (op, parameters) in ENTRIES.items()}
