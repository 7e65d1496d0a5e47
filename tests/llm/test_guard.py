"""Nothing outside imports the subpackage."""

import pathlib
import re


def test_nothing_else_imports_llm():
    root = pathlib.Path(__file__).parents[2]
    for p in [*root.glob("quillspark/**/*.py"), root / "bench.py"]:
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"(import|from)\s+(quillspark\.llm|corpus_pipeline)", p.read_text()), p
