import random
from dataclasses import replace
from types import SimpleNamespace

import pytest

from linkloom import InputPaths, Resolver, ResolverConfig, resolve_paths, runtime
from linkloom.operators import expansion
from linkloom.plans import paths
from linkloom.runtime import materialize, run_scope
from linkloom.sources import readers
from tests.conftest import pairs, rows
from workloads import queries


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Two collections of 40 entities with names, years and links among them."""
    folder, rng = tmp_path_factory.mktemp("inputs"), random.Random(2)
    years = [rng.randrange(8) for _ in range(40)]
    links = [rng.sample(range(40), 3) for _ in range(40)]
    for c in (1, 2):
        text = ""
        for i in range(40):
            # Half the names agree, each second one is lost in collection 2.
            name = f"thing {i}" if c == 1 or i % 2 else f"other {i}"
            text += f'<http://C{c}/{i}> <http://c{c}/name> "{name}" .\n'
            text += "".join(f"<http://C{c}/{i}> <http://c{c}/near> <http://C{c}/{j}> .\n" for j in links[i])
        (folder / f"kb{c}").write_text(text)
        (folder / f"ids{c}").write_text("".join(f"<http://C{c}/{i}>\t{i}\n" for i in range(40)))
    blocks = ""
    for b in range(12):
        inside = [i for i in range(40) if years[i] == b] if b < 8 else rng.sample(range(40), 5)
        blocks += f"{b}\t{''.join(f'{i}#' for i in inside)};{''.join(f'{-i - 1}#' for i in inside)}\n"
    (folder / "blocks").write_text(blocks)
    (folder / "truth").write_text("".join(f"<http://C1/{i}>,<http://C2/{i}>\n" for i in range(40)))
    return folder


CONFIG = ResolverConfig(label_attributes1=("<http://c1/name>",), label_attributes2=("<http://c2/name>",))


def inputs(folder):
    return InputPaths(*(str(folder / name) for name in ("blocks", "kb1", "kb2", "ids1", "ids2")))


def in_memory(spark, folder):
    return rows(paths.open_resolver(spark, inputs(folder), CONFIG).run())


def test_a_run_from_files_to_a_file(spark, files, tmp_path):
    got = resolve_paths(spark, inputs(files), str(tmp_path / "out"), str(tmp_path / "work"), CONFIG)
    found = rows(got)
    assert found == in_memory(spark, files) and len(found) >= 20
    assert {(-i - 1, i) for i in range(1, 40, 2)} <= set(found)
    assert list((tmp_path / "work").iterdir()) == []
    row = paths.evaluate_paths(spark, str(tmp_path / "out"), str(files / "truth"), inputs(files)).first()
    hits = sum(d2 == -d1 - 1 for d2, d1 in found)
    assert (row.tp, row.tp + row.fn) == (hits, 40)


def test_an_interrupted_run_goes_on(spark, files, tmp_path, monkeypatch):
    work, out = tmp_path / "work", str(tmp_path / "out")

    def lost(self):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(Resolver, "match_without_labels", lost)
        with pytest.raises(RuntimeError):
            resolve_paths(spark, inputs(files), out, str(work), CONFIG)
    (run,) = work.iterdir()
    finished = {p.name: p.stat().st_mtime_ns for p in run.glob("*/_SUCCESS")}
    kept = {p.parent.name for p in run.glob("*/_SUCCESS")}
    assert "label-matches-1" in kept and finished
    with pytest.raises(ValueError):
        paths.read_matches(spark, out)
    # A table without its mark was cut off while it was written.
    (run / "label-matches-1" / "_SUCCESS").unlink()
    computed, write = [], runtime.is_complete

    def seen(session, path):
        done = write(session, path)
        computed.append((path.rsplit("/", 1)[1], done))
        return done

    monkeypatch.setattr(runtime, "is_complete", seen)
    got = resolve_paths(spark, inputs(files), out, str(work), CONFIG)
    assert {name for name, done in computed if done} == kept - {"label-matches-1"}
    assert rows(got) == in_memory(spark, files)
    assert list(work.iterdir()) == []


def test_other_inputs_or_parameters_are_another_run(spark, files, tmp_path):
    here = inputs(files)
    digest = runtime.input_digest(spark, here.all(), "a")
    assert digest == runtime.input_digest(spark, here.all(), "a")
    assert digest != runtime.input_digest(spark, here.all(), "b")
    (tmp_path / "blocks").write_text("0\t1#;-1#\n")
    assert digest != runtime.input_digest(spark, replace(here, blocks=str(tmp_path / "blocks")).all(), "a")


def test_a_scope_ends_with_its_run(spark, tmp_path):
    before = runtime.checkpoint_root(spark)
    with run_scope(spark, str(tmp_path / "run")):
        assert rows(materialize(pairs(spark, [(-1, 2)]), "t")) == [(-1, 2)]
        assert rows(materialize(pairs(spark, [(-2, 3)]), "t")) == [(-2, 3)]
        assert sorted(p.name for p in (tmp_path / "run").iterdir()) == ["t-1", "t-2"]
    assert not (tmp_path / "run").exists()
    assert rows(materialize(pairs(spark, [(-1, 2)]), "t")) == [(-1, 2)]
    assert runtime.checkpoint_root(spark) == before and not (tmp_path / "run").exists()


@pytest.mark.parametrize("cell", [3, 4096])
def test_expanded_block_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr("linkloom.operators.shared_top_k.CELL", cell)
    blocks = {"a": (range(12), range(-9, 0)), "b": ([3, 6], [-3]), "c": ([1], [-1, -2, -6])}
    data = [(b, e, len(o), len(t)) for b, (o, t) in blocks.items() for e in (*o, *t)]
    sized = spark.createDataFrame(data, "block_id string, entity_id bigint, n1 bigint, n2 bigint")
    want = []
    for b, (one, two) in blocks.items():
        for mine, other in ((one, two), (two, one)):
            want += [(e, c, b, len(mine), len(other)) for e in mine for c in other if e % 3 == 0]
    assert rows(expansion.block_pairs(sized, lambda e: e % 3 == 0)) == sorted(want)


@pytest.mark.parametrize("cell", [3, 4096])
def test_candidate_pairs_lists_every_candidate(spark, monkeypatch, cell):
    """The query gives the pairs of the expansion, not their counts."""
    monkeypatch.setattr("linkloom.operators.shared_top_k.CELL", cell)
    blocks = {"a": (range(7), range(-5, 0)), "b": ([3, 6], [-3]), "c": ([1], [-1, -2])}
    data = [(b, e, len(o), len(t)) for b, (o, t) in blocks.items() for e in (*o, *t)]
    sized = spark.createDataFrame(data, "block_id string, entity_id bigint, n1 bigint, n2 bigint")
    want = []
    for b, (one, two) in blocks.items():
        for mine, other in ((one, two), (two, one)):
            want += [(e, c, b, len(mine), len(other)) for e in mine for c in other]
    monkeypatch.setattr(queries.views, "document_resolver", lambda *_: SimpleNamespace(sized_blocks=sized))
    assert rows(queries.candidate_pairs(spark, "")) == sorted(want)


@pytest.mark.parametrize("cell", [2, 4096])
def test_expanded_neighbor_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr("linkloom.operators.shared_top_k.CELL", cell)
    near = {1: [10, 11, 12, 13, 14], 2: [10], -1: [-10, -11, -12], -2: [-12]}
    edges = {(-1, 1): 500_000_000_000, (-2, 1): 250_000_000_000, (-1, 2): 125_000_000_000, (-9, 1): 1}
    inn = spark.createDataFrame([(e, x) for e, l in near.items() for x in l], "entity_id bigint, in_id bigint")
    links = spark.createDataFrame(
        [(d2, d1, w, len(near[d1]), len(near[d2])) for (d2, d1), w in edges.items() if d2 in near],
        "d2_id bigint, d1_id bigint, weight bigint, n1 bigint, n2 bigint",
    )
    want = []
    for (d2, d1), w in edges.items():
        for x in near.get(d1, []):
            for y in near.get(d2, []):
                want += [(e, c, d2, d1, w / 1e12) for e, c in ((x, y), (y, x)) if e % 2 == 0]
    assert rows(expansion.neighbor_pairs(links, inn, lambda e: e % 2 == 0)) == sorted(want)


def test_no_pairs_of_no_entities(spark):
    sized = spark.createDataFrame([], "block_id string, entity_id bigint, n1 bigint, n2 bigint")
    assert rows(expansion.block_pairs(sized, lambda e: e % 100 == 0)) == []
    assert rows(readers.parse_blocks(spark.createDataFrame([], "value string"))) == []
