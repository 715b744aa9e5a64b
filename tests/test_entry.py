import subprocess
import sys
from pathlib import Path

import pytest

SCRIPT = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), any(n.startswith("op") for n in e.queries()))
"""


@pytest.mark.parametrize("name", ["barloom.llm", "corpus_pipeline", "public_tokenizers", "xxhash", "ahocorasick"])
def test_bar_queries_are_there_without_the_text_part(name):
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(name=name)], capture_output=True, text=True, check=True, cwd=Path(__file__).resolve().parents[1]).stdout.split()
    assert int(out[0]) > 70 and int(out[1]) > 60 and (name == "ahocorasick" or out[2] == "False")


def test_other_missing_modules_are_errors():
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(name="barloom.plans")], capture_output=True, text=True, cwd=Path(__file__).resolve().parents[1])
    assert out.returncode and "barloom.plans" in out.stderr
