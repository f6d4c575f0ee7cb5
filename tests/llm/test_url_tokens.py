import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from leadloom.llm import url_filter as uf

RULES = uf.production_rules()
PATTERNS = {r.pattern: [set(x.tokens) for x in RULES if x.pattern == r.pattern] for r in RULES}


@pytest.mark.parametrize("pattern", sorted(PATTERNS))
def test_every_fitting_url_holds_the_tokens(pattern):
    """A rule is only found through its tokens, so no text that its expression fits may lack those of every rule that has it."""

    @settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.from_regex(re.compile(pattern, re.A), fullmatch=False).filter(lambda s: s.isascii() and "\n" not in s))
    def check(fitting):
        held = set(re.findall(uf.TOKEN, fitting.lower()))
        assert any(tokens <= held for tokens in PATTERNS[pattern])

    check()
