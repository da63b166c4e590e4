"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from quarterlode.llm.cotrain import op9_cotrain
from quarterlode.llm.forest import OP2_SQL, op2_forest
from quarterlode.llm.jaccard import OP8_SQL, op8_jaccard
from quarterlode.llm.langid import op5_langid
from quarterlode.llm.media import op3_media
from quarterlode.llm.middle import OP13_SQL, op13_middle
from quarterlode.llm.mixing import OP1_SQL, op1_mixing
from quarterlode.llm.packing import op11_packing
from quarterlode.llm.pieces import op7_pieces
from quarterlode.llm.privacy import op4_privacy
from quarterlode.llm.secrets import op6_secrets
from quarterlode.llm.sharding import op10_sharding
from quarterlode.llm.variants import op12_variants


def queries() -> dict:
    return {"op1_mixing": op1_mixing, "op2_forest": op2_forest, "op3_media": op3_media, "op4_privacy": op4_privacy, "op5_langid": op5_langid, "op6_secrets": op6_secrets, "op7_pieces": op7_pieces, "op8_jaccard": op8_jaccard, "op9_cotrain": op9_cotrain, "op10_sharding": op10_sharding, "op11_packing": op11_packing, "op12_variants": op12_variants, "op13_middle": op13_middle}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op2_forest": OP2_SQL, "op8_jaccard": OP8_SQL, "op13_middle": OP13_SQL}
