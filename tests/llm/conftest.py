import pytest

pytest.importorskip("loomspan.llm", reason="the subpackage is absent")
