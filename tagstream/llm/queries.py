"""The queries of this subpackage and, where SQL can express them, their SQL."""

from . import html, interaction, jaccard, mixing, ogg, packing, periodic, pii, quality, secrets, simhash, templates, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing, "op2_html": html.op2_html, "op3_secrets": secrets.op3_secrets, "op4_jaccard": jaccard.op4_jaccard,
    "op5_packing": packing.op5_packing, "op6_templates": templates.op6_templates, "op7_ogg": ogg.op7_ogg, "op8_pii": pii.op8_pii,
    "op9_quality": quality.op9_quality, "op10_toxicity": toxicity.op10_toxicity,
    "op11_simhash": simhash.op11_simhash, "op12_periodic": periodic.op12_periodic, "op13_interaction": interaction.op13_interaction,
}
SQL = {"op4_jaccard": jaccard.ORACLE, "op13_interaction": interaction.ORACLE}
