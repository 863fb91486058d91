"""Training rows are those of all features, and only what they are made of passes through the windows."""

from __future__ import annotations

import pytest

from flowtally.operators import windows as win
from flowtally.plans import packet_queries as packets, report_queries as reports
from flowtally.sources.tables import FLOW


@pytest.fixture
def seen(monkeypatch):
    """What goes into the windows."""
    given, run = [], win.flow_windows
    monkeypatch.setattr(win, "flow_windows", lambda rows, *a, **k: given.append(rows.columns) or run(rows, *a, **k))
    return given


def test_training_rows_are_those_of_all_features(spark, sf_dir, seen):
    narrow, columns = reports._training_rows(spark, sf_dir)
    wide = packets.labelled(spark, sf_dir).where("label is not null").select(*FLOW, "pkt_idx", "label", *columns)
    assert set(seen[0]) == set(packets.TRAINING_ROW) and len(seen[1]) > 2 * len(seen[0])
    want, got = wide.collect(), narrow.collect()
    assert len(got) == len(want) > 0 and sorted(map(repr, (tuple(map(float, r[:5])) + tuple(r[5:]) for r in got))) == sorted(map(repr, (tuple(map(float, r[:5])) + tuple(r[5:]) for r in want)))


def test_wide_training_rows_take_no_more_columns(spark, sf_dir, seen):
    rows = reports._wide_training_rows(spark, sf_dir)
    assert set(seen[0]) == set(packets.TRAINING_ROW) and rows.columns == [*FLOW, "pkt_idx", "label", *reports.SELECTED]
