"""The entry point stands without the optional subpackage, and without a package that it needs."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = """
import sys
blocked = {blocked!r}

class Block:
    def find_spec(self, name, path=None, target=None):
        if name == blocked or name.startswith(blocked + "."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)

sys.meta_path.insert(0, Block())
import __spark_entry__ as entry
names = entry.queries()
print(len(names), sum(n.startswith("op") and n[2].isdigit() for n in names), "pipeline" in names, entry.MISSING, sep="|")
"""


def without(blocked):
    run = subprocess.run([sys.executable, "-c", COUNT.format(blocked=blocked)], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True)
    return run.stdout.strip().split("|")


@pytest.mark.parametrize("blocked", ["tidemark.llm", "ahocorasick"])
def test_other_queries_stand_alone(blocked):
    from tidemark.plans.catalogue import CATALOGUE
    count, texts, pipeline, missing = without(blocked)
    assert int(count) == len(CATALOGUE) and texts == "0" and pipeline == "False"
    assert blocked in missing or not (ROOT / "tidemark/llm").exists()


def test_a_missing_pipeline_leaves_the_text_queries_alone():
    if not (ROOT / "tidemark/llm").exists():
        pytest.skip("the optional subpackage is not there")
    assert without("corpus_pipeline")[2] == "False"
    assert int(without("corpus_pipeline")[1]) >= 10
