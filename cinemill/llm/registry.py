"""The subpackage's registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from cinemill.llm.decontaminate import op9_decontaminate
from cinemill.llm.htmlcrf import op8_html
from cinemill.llm.interaction import OP11_SQL, op11_interaction
from cinemill.llm.media import op6_media
from cinemill.llm.packing import op2_packing
from cinemill.llm.periodic import op13_periodic
from cinemill.llm.pii import op4_pii
from cinemill.llm.quality import op10_quality
from cinemill.llm.rans import op7_rans
from cinemill.llm.riskrules import op12_rules
from cinemill.llm.secrets import op1_secrets
from cinemill.llm.simhash import op5_simhash
from cinemill.llm.substrings import op3_substrings

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_packing": op2_packing,
    "op3_substrings": op3_substrings,
    "op4_pii": op4_pii,
    "op5_simhash": op5_simhash,
    "op8_html": op8_html,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality": op10_quality,
    "op6_media": op6_media,
    "op7_rans": op7_rans,
    "op11_interaction": op11_interaction,
    "op12_rules": op12_rules,
    "op13_periodic": op13_periodic,
}

ORACLE_SQL: dict[str, str] = {"op11_interaction": OP11_SQL}
