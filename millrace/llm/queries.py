"""The queries of this subpackage and their SQL, as the driver's entry adds them."""

from __future__ import annotations

from .bpe import op6_bpe_tree
from .html_blocks import op7_html_blocks
from .kdtree import op1_kd_tree
from .licenses import OP8_SQL, op8_license_cosine
from .lines import OP2_SQL, op2_line_frequency
from .mixing import op9_temperature_mix
from .neardup import op4_projection_passes
from .secrets import op3_secret_layers
from .simhash import op5_simhash_pigeonhole
from .warc import op10_warc_shards

QUERIES = {
    "op1_kd_tree": op1_kd_tree,
    "op2_line_frequency": op2_line_frequency,
    "op3_secret_layers": op3_secret_layers,
    "op4_projection_passes": op4_projection_passes,
    "op5_simhash_pigeonhole": op5_simhash_pigeonhole,
    "op6_bpe_tree": op6_bpe_tree,
    "op7_html_blocks": op7_html_blocks,
    "op8_license_cosine": op8_license_cosine,
    "op9_temperature_mix": op9_temperature_mix,
    "op10_warc_shards": op10_warc_shards,
}

ORACLE: dict[str, str] = {"op2_line_frequency": OP2_SQL, "op8_license_cosine": OP8_SQL}
