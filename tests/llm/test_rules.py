"""What the operators of this subpackage do not do."""

import ast
from pathlib import Path

import callscope.llm

FOLDER = Path(callscope.llm.__file__).parent
FILES = [*FOLDER.glob("*.py"), FOLDER.parent.parent / "corpus_pipeline.py"]


def test_nothing_whole_goes_through_the_driver():
    banned = {"collect", "toPandas", "toLocalIterator", "crossJoin", "localCheckpoint"}
    for path in FILES:
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
                assert node.func.attr not in banned, f"{path.name}: {node.func.attr}"


def test_the_rest_of_the_package_does_not_know_it():
    for path in FOLDER.parent.rglob("*.py"):
        if FOLDER not in path.parents:
            assert "callscope.llm" not in path.read_text()


def test_every_operator_has_one_query():
    from callscope.llm.catalog import load

    queries, oracles = load()
    assert sorted(int(name[2:].split("_")[0]) for name in queries if name.startswith("op")) == list(range(1, 14))
    assert set(queries) - {name for name in queries if name.startswith("op")} == {"pipeline"} and set(oracles) <= set(queries)
