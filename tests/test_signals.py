"""Names of code and of errors in prompts: what counts, what does not."""

import pytest
from pyspark.sql import functions as F

from heronry.functions import text as T

#: (prompt, symbols it has, symbols it has not)
SYMBOLS = [
    ("Investigate the login flow and trace why it fails.", (), ("Investigate",)),
    ("Plan the move off the old ranker.", (), ("Plan",)),
    ("Review the login flow. Then look at the `Investigate` helper.", ("Investigate",), ("Review",)),
    ("Runs must NEVER serve fakes. Use REAL models under TDD.", (), ("NEVER", "REAL", "TDD")),
    ("The test ran (twice), the check failed (once); is it true (so)?", (), ("ran", "failed", "true")),
    ("The `ran` flag, a `bug` and `true` are prose.", (), ("ran", "bug", "true")),
    ("Refactor `TermScorer` and `hasRanker` in the `RankPipeline`; load `bge-v2-ONNX`, read `snake_case` and `dotted.path`.", ("TermScorer", "hasRanker", "RankPipeline", "bge-v2-ONNX", "snake_case", "dotted.path"), ("Refactor",)),
    ("Call searchContext() then hasRanker() to see.", ("searchContext", "hasRanker"), ("Call",)),
    ("See UserStore and Sha256 in src/lib/FooBar.ts", ("UserStore", "Sha256"), ("FooBar", "Store")),
    ("README_DRAFT is a document, RUN_2 is not", ("RUN_2",), ("README_DRAFT",)),
]
ERRORS = [
    ("NULLError and TypeError, IO_Failure", ("NULLError", "IO_Failure"), ("TypeError",)),
    ("HTTP_AUTH_42, API-KEY, README_DRAFT, E_AUTH", ("HTTP_AUTH_42", "API-KEY"), ("README_DRAFT", "E_AUTH")),
    ("TS2345, ERR-17 and ERR_123 and E404", ("TS2345", "ERR-17", "ERR_123", "E404"), ()),
]


@pytest.mark.parametrize("function,cases", [(T.symbols, SYMBOLS), (T.errors, ERRORS)])
def test_names(spark, function, cases):
    rows = spark.createDataFrame([(k, p) for k, (p, _, _) in enumerate(cases)], "k int, prompt string").select("k", function(F.col("prompt")).alias("found")).collect()
    for r in rows:
        prompt, has, has_not = cases[r.k]
        assert set(has) <= set(r.found) and not set(has_not) & set(r.found) and len(set(r.found)) == len(r.found), (prompt, r.found)
