"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from . import quality_rules, search, warc
from .classifier import op3_classifier
from .conversations import op11_conversations
from .decontamination import op9_decontamination
from .lm import op1_lm
from .mixing import op7_mixing
from .personal import op12_personal
from .quality_rules import op8_quality_rules
from .search import op13_search
from .secrets import op6_secrets
from .simhash import op10_simhash
from .substrings import op4_substrings
from .url_filters import op2_url_filters
from .warc import op5_warc

QUERIES = {
    "op1_lm": op1_lm,
    "op3_classifier": op3_classifier,
    "op2_url_filters": op2_url_filters,
    "op4_substrings": op4_substrings,
    "op5_warc": op5_warc,
    "op6_secrets": op6_secrets,
    "op7_mixing": op7_mixing,
    "op8_quality_rules": op8_quality_rules,
    "op9_decontamination": op9_decontamination,
    "op10_simhash": op10_simhash,
    "op11_conversations": op11_conversations,
    "op12_personal": op12_personal,
    "op13_search": op13_search,
}

ORACLES: dict[str, str] = {
    "op5_warc": warc.ORACLE,
    "op8_quality_rules": quality_rules.ORACLE,
    "op13_search": search.ORACLE,
}
