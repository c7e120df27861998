"""What keeps a stored slice from being replayed, one fault to an epoch."""

from vigil.operators import ledger as L

BY = "fleet long, epoch long, start_ms long"


def test_each_replay_fault(spark):
    base = {
        "manifest": [(100, 200, 2, 1, 9)], "inputs": [(0, 5, 110, "a", "a"), (1, 9, 150, "b", "b")], "history": [(0, 0, 100, None, "m", "m")], "cuts": [(0, "b", 150), (1, "z", 30), (2, None, None)],
        "witnesses": [(0, "b", 150, "scope"), (1, "z", 30, "pulse")],
    }
    cases = [
        ({}, None), ({"manifest": [(100, 200, 3, 1, 9)]}, "LENGTH"), ({"inputs": [(0, 5, 110, "a", "x"), (1, 9, 150, "b", "b")]}, "INPUT_HASH"), ({"inputs": [(0, 9, 110, "a", "a"), (1, 9, 150, "b", "b")]}, "INDEX_ORDER"),
        ({"inputs": [(0, 5, 110, "a", "a"), (1, 9, 200, "b", "b")]}, "OUTSIDE_WINDOW"), ({"manifest": [(100, 200, 2, 1, 8)]}, "BEYOND_THROUGH"), ({"manifest": [(100, 200, 2, 2, 9)]}, "HISTORY_LENGTH"), ({"history": []}, "HISTORY_LENGTH"),
        ({"history": [(0, 0, 100, None, "m", "n")]}, "HISTORY_HASH"), ({"history": [(0, 0, 100, 77, "m", "m")]}, "HISTORY_EPOCH"), ({"history": [(0, 0, 99, None, "m", "m")]}, "HISTORY_END"),
        ({"manifest": [(100, 200, 2, 2, 9)], "history": [(0, 0, 40, None, "m", "m"), (1, 50, 100, None, "n", "n")]}, "HISTORY_GAP"),
        ({"witnesses": [(0, "b", 150, "scope")]}, "WITNESS_LENGTH"), ({"witnesses": [(0, "b", 150, "scope"), (2, "z", 30, "pulse")]}, "WITNESS_SOURCE"), ({"witnesses": [(0, "c", 150, "scope"), (1, "z", 30, "pulse")]}, "WITNESS_HASH"),
        ({"witnesses": [(0, "b", 151, "scope"), (1, "z", 30, "pulse")]}, "WITNESS_TIME"), ({"witnesses": [(0, "b", 150, "signal"), (1, "z", 30, "pulse")]}, "WITNESS_SIGNAL"),
        ({"manifest": [(100, 200, 0, 0, None)], "inputs": [], "history": [], "cuts": [], "witnesses": []}, None),
    ]
    rows = {name: [] for name in base}
    for epoch, (change, _) in enumerate(cases):
        for name, some in (base | change).items():
            for x in some:
                x = list(x)
                if name == "history":
                    x[3] = epoch if x[3] is None else x[3]
                rows[name].append((0, epoch, 100, *(x[1:] if name == "manifest" else x)))
    frame = lambda name, ddl: spark.createDataFrame(rows[name], f"{BY}, {ddl}")
    told = L.replay_faults(
        frame("manifest", "end_ms long, n_inputs long, n_history long, through long"), frame("inputs", "position long, idx long, received_ms long, hash string, listed string"),
        frame("history", "position long, prior_start_ms long, prior_end_ms long, prior_epoch long, prior_hash string, listed string"), frame("cuts", "source long, last_input string, last_ms long"),
        frame("witnesses", "source long, hash string, received_ms long, kind string"),
    )
    assert {r.epoch: r.fault for r in told.collect()} == {i: fault for i, (_, fault) in enumerate(cases)}
