"""What readers understand of a session: questions about it, contexts that show it, answers of a panel, grades."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators import evaluation, views
from runloom.workbench import ask_panel

ANSWERS = "transcript string, condition string, reader string, qid string, kind string, truth array<string>, answer string"


def answers(state: DataFrame, events: DataFrame, lines: DataFrame, panel: dict[str, Callable[[str], str]]) -> DataFrame:
    """Rows of ANSWERS: each reader of the panel is asked all questions about a session at once, for each way of showing it.

    Readers are called where the rows are, a context at a time, so they must be picklable (a function that opens its own
    connection); a reader that fails has answered nothing.
    """
    asked = views.questions(state, events).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("qid", "ask", "kind", "truth"))).alias("asked"))
    shown = views.conditions(state, events, lines).join(asked, "path")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for reader, client in panel.items():
                    try:
                        said = ask_panel(client, row["context"], row["asked"])
                    except Exception:  # noqa: BLE001  whatever a client raises
                        said = {}
                    out += [(row["path"], row["condition"], reader, q["qid"], q["kind"], q["truth"], said.get(q["qid"])) for q in row["asked"]]
            arrays = [pa.array(c) for c in zip(*out)] if out else []
            if out:
                arrays[5], arrays[6] = pa.array([r[5] for r in out], pa.list_(pa.string())), pa.array([r[6] for r in out], pa.string())
                yield pa.RecordBatch.from_arrays(arrays, names=["transcript", "condition", "reader", "qid", "kind", "truth", "answer"])

    return shown.select("path", "condition", "context", "asked").mapInArrow(each, ANSWERS)


def comprehension(state: DataFrame, events: DataFrame, lines: DataFrame, panel: dict[str, Callable[[str], str]]) -> DataFrame:
    """Mean grade by condition, by condition and question, and by condition and transcript."""
    return evaluation.condition_accuracy(evaluation.grade(answers(state, events, lines, panel)))
