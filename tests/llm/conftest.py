import pytest

pytest.importorskip("ledgerlight.llm")
