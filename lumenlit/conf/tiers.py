"""An ordered decision list over extracted fields, as SQL conditions.

Columns: study_phase, endpoint_type, endpoint_met, direction, hazard (null if
not given), p_significant, hard_to_treat, single_arm, signal_type, gate, rejected
and elevates.
"""

_GAIN = "direction IN ('positive', 'non_inferior')"
_REVIEW = "study_phase IN ('meta_analysis', 'systematic_review')"
_SURVIVAL = "study_phase = 'phase3_rct' AND endpoint_type = 'overall_survival'"
_CLEAN = "endpoint_met AND p_significant AND direction = 'positive'"

# Tiers by the first condition that holds.
TIERS = [
    ("rejected", "NOISE"),
    ("study_phase = 'phase2_single_arm' AND single_arm AND direction = 'positive' AND (endpoint_met OR hard_to_treat)", "C"),
    ("study_phase = 'phase2_single_arm' AND single_arm", "NOISE"),
    ("signal_type IN ('FDA_APPROVAL', 'GUIDELINE_UPDATE')", "A"),
    ("signal_type IN ('PHASE_III_NEGATIVE', 'SAFETY_SIGNAL') AND elevates", "A"),
    ("signal_type IN ('PHASE_III_NEGATIVE', 'SAFETY_SIGNAL')", "B"),
    (f"{_REVIEW} AND gate <> 'GUIDELINE' AND endpoint_met AND p_significant AND {_GAIN}", "B"),
    (f"{_REVIEW} AND gate <> 'GUIDELINE' AND direction = 'positive'", "C"),
    (f"{_REVIEW} AND gate <> 'GUIDELINE'", "NOISE"),
    ("gate = 'NEGATIVE_TRIAL' AND study_phase = 'phase3_rct'", "B"),
    ("gate = 'NEGATIVE_TRIAL'", "C"),
    ("gate = 'GUIDELINE' OR study_phase = 'guideline_update'", "A"),
    (f"{_SURVIVAL} AND {_CLEAN} AND coalesce(hazard, 0) <= 0.82", "A"),
    (f"{_SURVIVAL} AND {_CLEAN}", "B"),
    (f"{_SURVIVAL} AND direction = 'non_inferior' AND endpoint_met", "A"),
    (f"study_phase = 'phase3_rct' AND endpoint_met AND p_significant AND {_GAIN}", "B"),
    (f"{_SURVIVAL} AND direction = 'positive' AND hazard <= 0.85", "B"),
    ("study_phase = 'phase3_rct' AND direction = 'non_inferior' AND endpoint_met", "B"),
    ("study_phase = 'phase2_rct' AND endpoint_met AND direction = 'positive' AND (p_significant OR hard_to_treat)", "B"),
    ("gate = 'MAJOR_CONFERENCE' AND study_phase = 'phase3_rct' AND direction = 'positive'", "B"),
    ("study_phase = 'phase2_rct' AND direction = 'positive' AND NOT endpoint_met", "C"),
    ("study_phase = 'phase2_rct' AND hard_to_treat AND direction IN ('positive', 'inconclusive')", "C"),
    ("study_phase = 'phase2_single_arm' AND direction = 'positive' AND (endpoint_met OR hard_to_treat)", "C"),
    ("gate IN ('MAJOR_CONFERENCE', 'TOP_JOURNAL', 'REGULATORY_PHASE_II') AND direction = 'positive'", "C"),
]
DEFAULT_TIER = "NOISE"

# The enumerations of the extracted fields.
PHASES = ["phase3_rct", "phase2_rct", "phase2_single_arm", "phase1", "meta_analysis", "systematic_review", "guideline_update", "fda_approval", "observational", "other_or_unclear"]
DIRECTIONS = ["positive", "non_inferior", "negative", "inconclusive", "not_reported"]
SIGNAL_TYPES = ["OTHER", "FDA_APPROVAL", "GUIDELINE_UPDATE", "PHASE_III_NEGATIVE", "SAFETY_SIGNAL"]
GATES = ["NONE", "FDA", "GUIDELINE", "NEGATIVE_TRIAL", "MAJOR_CONFERENCE", "TOP_JOURNAL", "REGULATORY_PHASE_II", "PHASE_III_RANDOMIZED"]
BLANK_CHANGES = ["", "not_reported", "Not applicable", "N/A", "n/a", "not applicable", "None"]
