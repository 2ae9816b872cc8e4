"""Tables of systems are read from notes put in order once: no task sorts them again for each table."""

import io
from contextlib import redirect_stdout

from tonelake.plans import q_systems


def test_no_table_sorts_the_notes_again(spark):
    for name, table in q_systems.tables(spark, "/root/testdata/sf0.001").items():
        shown = io.StringIO()
        with redirect_stdout(shown):
            table.explain()
        assert "Window" not in shown.getvalue(), name
