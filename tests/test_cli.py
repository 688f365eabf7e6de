"""The command line lists every check and prints a check's DuckDB twin."""

import contextlib
import io

from opsight.__main__ import main
from opsight.plans.registry import registry


def run(argv):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        code = main(argv)
    return code, out.getvalue()


def test_list_names_every_check():
    code, out = run(["list"])
    assert code == 0 and len(out.strip().splitlines()) == len(registry())


def test_sql_prints_the_oracle_twin():
    code, out = run(["sql", "max_key"])
    assert code == 0 and "fx_batches" in out and "max(dw_date_key)" in out


def test_unknown_check_is_an_error():
    assert run(["sql", "no_such_check"])[0] == 2
