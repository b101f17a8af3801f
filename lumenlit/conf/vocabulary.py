"""Vocabularies of the oncology configuration. Every operator takes its own instead if given."""

# Journals from the most to the least weighty, for ties between copies.
JOURNAL_RANK = [
    "new england journal of medicine", "lancet", "lancet oncology", "jama", "jama oncology", "journal of clinical oncology", "nature medicine", "nature cancer", "annals of oncology", "blood", "european urology",
    "journal of thoracic oncology", "gut", "hepatology", "journal of hepatology", "lancet haematology", "lancet gastroenterology and hepatology", "neuro-oncology",
    "international journal of radiation oncology biology physics", "radiotherapy and oncology", "gynecologic oncology", "head & neck", "oral oncology", "breast cancer research and treatment", "leukemia", "cancer", "jnci",
]
DEFAULT_JOURNAL_RANK = 127

# Publication types that keep a record, that pass at low priority, and that drop it.
KEEP_TYPES = [
    "randomized controlled trial", "clinical trial, phase ii", "clinical trial, phase iii", "clinical trial, phase iv", "controlled clinical trial", "equivalence trial", "pragmatic clinical trial", "meta-analysis", "systematic review",
    "practice guideline", "guideline", "consensus development conference", "consensus development conference, nih", "validation study", "evaluation study", "multicenter study", "observational study",
]
LOW_PRIORITY_TYPES = ["clinical trial", "clinical trial, phase i", "comparative study", "clinical study", "journal article", "twin study", "clinical conference", "congress", "published erratum"]
DROP_TYPES = ["editorial", "comment", "letter", "news", "biography", "personal narrative", "interview", "introductory journal article", "case reports", "review", "historical article", "video-audio media"]

# Terms of the relevance score.
ENDPOINT_TERMS = ["overall survival", "OS", "PFS", "progression-free survival", "DFS", "disease-free survival", "EFS", "event-free survival", "RFS", "recurrence-free", "MFS", "metastasis-free", "objective response", "ORR", "complete response", "partial response", "toxicity", "adverse event", "grade 3", "grade 4", "quality of life", "QoL", "patient-reported outcome", "PRO", "non-inferior", "non-inferiority", "noninferior", "hazard ratio", "HR ", "95% CI"]
TRIAL_TERMS = ["randomized", "randomised", "phase 2", "phase II", "phase 3", "phase III", "noninferiority", "non-inferiority", "meta-analysis", "systematic review", "pooled analysis", "guideline", "consensus", "recommendation", "FDA approval", "label change", "regulatory"]
PRECLINICAL_TERMS = ["in vitro", "in vivo", "cell line", "xenograft", "mouse model", "murine model", "organoid", "preclinical", "knockout mice", "transgenic mice"]
CLINICAL_TERMS = ["patient", "clinical trial", "cohort", "biopsy", "circulating tumor", "ctDNA", "clinical", "prognostic", "predictive"]
BENIGN_TERMS = ["endometriosis", "fibroid", "leiomyoma", "polycystic ovary", "infertility"]
CANCER_TERMS = ["cancer", "carcinoma", "neoplasm", "malignancy", "tumor", "tumour"]
PEDIATRIC_TERMS = ["pediatric", "paediatric", "child", "children", "adolescent", "infant"]
PEDIATRIC_CANCER_TERMS = ["neuroblastoma", "medulloblastoma", "Wilms", "hepatoblastoma", "retinoblastoma", "rhabdomyosarcoma", "Ewing", "DIPG", "childhood leukemia", "childhood lymphoma"]

# Patterns of the gates, tried on lower-case text.
HARD_EXCLUDE = r"\b(mixture cure model|reconstructed.{0,12}(ipd|individual patient data)|narrative review|literature review|scoping review)\b"
HARD_EXCLUDE_TITLE = r"\b(post.hoc analysis|(reanalysis|re-analysis).{0,30}(phase (ii|iii|2|3)|trial|study)|(secondary analysis).{0,30}(phase (ii|iii|2|3)|trial data))\b"
APPROVAL = r"(fda.{0,5}(approv|granted|cleared|authorized)|fda.{0,10}(label|labeling).{0,15}(update|change|revision)|accelerated approval|full approval|regular approval|fda.{0,10}withdrawal|market withdrawal|(approv|granted).{0,30}(nda|bla|snda|sbla)\b|\b(nda|bla|snda|sbla).{0,30}approv)"
GUIDELINE_BODY = r"\b(nccn|asco|esmo|astro|ash|esgo|eortc|aua|nci|who|aad|american academy of dermatology|sua|eau|snmmi|abnm)\b"
GUIDELINE_EVENT = r"\b(guideline.{0,20}(update|change|revision|incorporat|now recommend)|updated.{0,15}guideline|new.{0,10}guideline|consensus.{0,15}(update|recommendation|statement)|practice.{0,10}guideline|clinical practice.{0,10}(update|guideline))\b"
PHASE_3 = r"\bphase.?(iii|3)\b"
PHASE_2 = r"\bphase.?(ii|2)\b"
RANDOMIZED = r"\b(randomized|randomised|rct|randomly (assigned|allocated|administered)|random assignment)\b"
BORROWED = r"\b(previously (reported|published).{0,20}(phase (iii|3)|trial)|(based on|from).{0,20}(phase (iii|3)|trial).{0,20}(data|results|population)|using data from.{0,30}(phase (iii|3)|trial))\b"
RETROSPECTIVE_TITLE = r"\b(retrospective (analysis|study|cohort|review|series)|(database|registry|seer|ncdb).{0,20}(analysis|study|cohort)|real.world (data|evidence|analysis|cohort)|administrative data|claims data)\b"
DEESCALATION = r"\b(non.?inferiority|noninferiority|de.escalation|deescalation|dose reduction|dose omission|treatment omission|omission of (chemotherapy|radiation|chemo|rt|radiotherapy|adjuvant)|watch.and.wait|active surveillance)\b"
SOCIETIES = ["ASCO", "ESMO", "ASTRO", "ASH", "AACR", "SITC", "SABCS", "ESGO"]
LATE_BREAKING = r"\b(late.breaking (abstract|trial|session|oral|data)|plenary (session|abstract|oral|presentation)|presidential (symposium|session))\b"
SOCIETY_LATE_BREAKING = r"(asco|esmo|astro|ash|aacr|sitc|sabcs|esgo).{0,30}(late.breaking|plenary|presidential)|(late.breaking|plenary|presidential).{0,30}(asco|esmo|astro|ash|aacr|sitc|sabcs|esgo)"
CONFERENCE_RESULT = r"\b(phase (ii|iii|2|3)|randomized|randomised|rct|overall survival|progression.free|disease.free|event.free|hazard ratio|median (os|pfs|dfs|efs)|primary endpoint met|primary outcome|pivotal|practice.changing|standard of care|fda.approv|guideline.{0,20}(update|incorporat|recommend))\b"
PROSPECTIVE = r"\b(randomized|randomised|rct|phase (i+|[1-3]) (trial|study|rct)|prospective (randomized|randomised|trial|study))\b"
RADIOTHERAPY_CHANGE = r"\b(dose escalation|dose de.escalation|dose reduction.{0,20}(radiation|rt|radiotherapy)|hypofractionat|hyperfractionat|accelerated fractionat|stereotactic (body|ablative|radiosurgery)|sbrt|sabr|srs|elective nodal (irradiation|treatment|radiation|field)|omission of (radiation|radiotherapy|rt|irradiation|elective)|radiation (field|volume).{0,20}(reduc|modif|chang|narrow)|whole.breast (irradiation|radiation)|accelerated partial.{0,5}breast|proton.{0,20}(versus|compared|randomized|trial)|particle (therapy|beam).{0,20}(versus|randomized|trial)|sequential.{0,10}versus.{0,10}concurrent.{0,20}(chemo|radiation|rt)|total (body|marrow|lymphoid).{0,10}irradiation|brachytherapy.{0,20}(randomized|versus|trial)|concurrent.{0,10}(chemoradiation|chemoradiotherapy).{0,20}(versus|compared|trial))\b"
REGULATORY = r"\b(accelerated approval|breakthrough therapy|orphan drug|orphan.{0,10}designation|rare.{0,10}(cancer|tumor|tumour|malignancy|disease|histology|sarcoma)|new standard of care|establishes.{0,10}standard|practice.changing|practice change|regulatory submission|nda|bla)\b"
META_ANALYSIS = r"\b(meta.analysis|systematic review|pooled analysis|individual patient data meta)\b"
NEGATIVE = r"(did not meet.{0,40}primary (endpoint|outcome)|primary (endpoint|outcome).{0,20}(was not met|not met|not achieved|not reached)|failed to meet.{0,30}primary (endpoint|outcome)|missed.{0,20}(its |the )?primary (endpoint|outcome)|failed to demonstrate.{0,40}(superiority|significant (benefit|improvement|difference))|did not (improve|demonstrate|achieve).{0,40}(overall survival|progression.free|primary endpoint)|no significant (difference|improvement|benefit).{0,30}(overall survival|progression.free survival|primary endpoint)|negative (trial|study|result).{0,20}(phase (ii|iii|2|3)|randomized|randomised)|(phase (ii|iii|2|3)|randomized|randomised).{0,30}negative (trial|study|result)|statistically (non.significant|not significant).{0,30}(primary|os\b|overall survival|pfs)|did not (reach|achieve).{0,30}(statistical significance|primary endpoint|os\b|pfs))"
TOP_JOURNAL_RESULT = r"\b(randomized|randomised|phase (ii|iii|2|3)|clinical trial|rct|noninferiority|non.inferiority|de.escalation|overall survival|progression.free|disease.free|event.free|locoregional control|local control|recurrence.free|objective response|pathologic response|complete response|hazard ratio|median (os|pfs|dfs|efs)\b|fda.approv|guideline|standard of care|practice.changing)\b"
REJECTIONS = [
    ("preclinical", "text", r"\b(in vitro|in vivo|cell line|xenograft|mouse model|murine|organoid|preclinical)\b"),
    ("surgical_technical", "title", r"\b(surgical (technique|approach|outcome|series)|operative technique|endoscopic|robotic|laparoscopic|auto.{0,5}(segmentation|contouring|delineation)|automated (segmentation|planning|delineation))\b"),
    ("exploratory_modeling", "text", r"\b(exploratory analysis|modeling study|simulation|statistical model|decision analysis|cost.effectiveness|cost.utility|markov model)\b"),
    ("review_meta_analysis", "text", r"\b(systematic review|meta.analysis|pooled analysis|literature review|scoping review)\b"),
    ("retrospective_database", "text", r"\b(retrospective|(database|registry).{0,10}(study|analysis|cohort)|seer|ncdb|nsqip|ehr|electronic health record|administrative data|claims data|real.world (data|evidence))\b"),
    ("prognostic_only", "text", r"\b(prognostic (factor|marker|model|score|index|nomogram|signature|biomarker)|predictive (model|score|nomogram))\b"),
]

# Journals that carry a result by themselves, and the wider list that a weak signal needs.
TOP_JOURNALS = [
    "new england journal of medicine", "nejm", "lancet", "jama", "nature medicine", "nejm evidence", "lancet oncology", "jama oncology", "journal of clinical oncology", "jco", "annals of oncology", "journal of the national cancer institute", "jnci", "cancer cell",
    "international journal of radiation oncology biology physics", "international journal of radiation oncology, biology, physics", "ijrobp", "radiotherapy and oncology", "practical radiation oncology", "journal of thoracic oncology", "european urology", "gynecologic oncology", "blood", "leukemia",
    "journal of hematology and oncology", "clinical cancer research", "jama dermatology", "british journal of dermatology", "journal of the american academy of dermatology", "journal of investigative dermatology", "pigment cell & melanoma research",
]
SOUND_JOURNALS = [*TOP_JOURNALS, "nature cancer", "nature reviews cancer", "nature reviews clinical oncology", "ca: a cancer journal for clinicians", "journal for immunotherapy of cancer", "jco precision oncology", "jco oncology practice", "annals of surgical oncology", "european journal of cancer", "british journal of cancer", "breast cancer research and treatment", "breast cancer research", "npj breast cancer", "cancer medicine", "cancer", "oncologist", "oncology", "haematologica", "american journal of hematology", "bone marrow transplantation", "prostate cancer and prostatic diseases", "urologic oncology", "urology", "journal of urology", "gastroenterology", "hepatology", "gut", "journal of hepatology", "dermatologic surgery", "npj precision oncology", "esmo open", "clinical oncology", "cancer communications"]

# Base points of the signals, and the points that the text adds.
SIGNAL_BASE = {"FDA": 100, "FORCE_KEEP": 100, "GUIDELINE": 90, "PHASE_III_RANDOMIZED": 85, "WATCHED_TRIAL": 85, "NEGATIVE_TRIAL": 80, "MAJOR_CONFERENCE": 75, "RANDOMIZED_DEESCALATION": 75, "PHASE_II_RANDOMIZED": 65, "DIRECT_RADONC_TRIAL": 65, "REGULATORY_PHASE_II": 50, "META_ANALYSIS": 40, "TOP_JOURNAL": 40, "LLM_CURATED": 55}
SCORE_TERMS = [
    (["overall survival", "os benefit", "median os", "improved survival"], 10, "OS"),
    (["progression-free", "progression free", "event-free", "event free", "metastasis-free", "metastasis free", "disease-free", "disease free", "recurrence-free", "recurrence free"], 6, "Survival endpoint"),
    (["radiation dose", "radiation field", "hypofractionat", "stereotactic", "sbrt", "sabr", "chemoradiation", "chemoradiotherapy", "radiotherapy", "brachytherapy", "elective nodal", "proton"], 8, "RT relevance"),
    (["de-escalation", "de escalation", "noninferiority", "non-inferiority"], 6, "De-escalation"),
    (["first-line", "first line", "frontline", "front-line"], 4, "First-line"),
    (["pancreatic", "sclc", "glioblastoma", "gbm", "mesothelioma"], 4, "Hard-to-treat cancer"),
    (["late-breaking", "late breaking", "plenary session", "presidential symposium"], 5, "LBA/plenary"),
    (["subgroup analysis", "post-hoc", "post hoc", "exploratory analysis", "hypothesis-generating"], -15, "Exploratory"),
]
COMMENTARY_TYPES = ["editorial", "comment", "letter", "review", "news"]

# Precedence of evidence, and the signal type of each gate.
SOURCE_PRIORITY = {"FDA": 0, "NCCN": 1, "ASCO": 2, "ESMO": 2, "ASTRO": 2, "PUBMED": 3, "JOURNAL": 3, "CONFERENCE_ABSTRACT": 4, "WEB_SEARCH": 5, "PRESS_RELEASE": 5}
SIGNAL_TYPE_PRIORITY = {"FDA_APPROVAL": 100, "GUIDELINE_UPDATE": 90, "PHASE_III_POSITIVE": 85, "PHASE_III_NEGATIVE": 80, "LATE_BREAKING_ABSTRACT": 75, "PRACTICE_CHANGING_PHASE_II": 65, "BIOMARKER_SIGNAL": 65, "RADONC_TECHNIQUE": 50, "DE_ESCALATION": 50, "SAFETY_SIGNAL": 50, "OTHER": 40}
SIGNAL_TYPE_OF_GATE = {"FDA": "FDA_APPROVAL", "GUIDELINE": "GUIDELINE_UPDATE", "PHASE_III_RANDOMIZED": "PHASE_III_POSITIVE", "NEGATIVE_TRIAL": "PHASE_III_NEGATIVE", "RANDOMIZED_DEESCALATION": "DE_ESCALATION", "MAJOR_CONFERENCE_HIGH": "LATE_BREAKING_ABSTRACT", "MAJOR_CONFERENCE_LOW": "OTHER", "MAJOR_CONFERENCE": "LATE_BREAKING_ABSTRACT", "DIRECT_RADONC_TRIAL": "RADONC_TECHNIQUE", "PHASE_II_RANDOMIZED": "PRACTICE_CHANGING_PHASE_II", "REGULATORY_PHASE_II": "PRACTICE_CHANGING_PHASE_II", "WATCHED_TRIAL": "PHASE_III_POSITIVE", "META_ANALYSIS": "OTHER", "TOP_JOURNAL": "OTHER", "FORCE_KEEP": "OTHER", "LLM_CURATED": "OTHER", "NONE": "OTHER"}
CONFIDENCE_RANK = {"fda": 100, "guideline": 90, "peer_reviewed": 80, "late_breaking_abstract": 70, "company_press_release": 40, "trade_press": 30, "llm_discovery": 20}
SETTING_NAMES = {"screening_prevention": "screening", "localized_definitive": "localized", "adjuvant": "adjuvant", "neoadjuvant": "neoadjuvant", "recurrent_metastatic": "metastatic", "maintenance": "metastatic", "survivorship_supportive": "supportive", "diagnostic": "localized", "other_or_unclear": "localized"}

# Conference supplements as (code, month, days of leeway).
MEETINGS = [("ASCO", 6, 14), ("ASCO_GU", 2, 14), ("ASCO_Breast", 10, 14), ("ESMO", 9, 14), ("ESMO_Breast", 5, 14), ("ASTRO", 10, 14), ("ASH", 12, 14), ("AACR", 4, 14), ("SGO", 3, 14), ("SITC", 11, 14)]

# Sites of each specialty; the first two and custom are not restricted by it.
ALL_SITES = ["gynecologic", "thoracic", "head_neck", "gu", "breast", "cns", "gastrointestinal", "cutaneous", "hematologic", "sarcoma", "pediatric"]
SPECIALTY_SITES = {"all_oncology": ALL_SITES, "radiation_oncology": ALL_SITES, "medical_oncology": [s for s in ALL_SITES if s != "hematologic"], "hematology_oncology": ["hematologic"], "gynecologic_oncology": ["gynecologic"], "thoracic_oncology": ["thoracic"], "gu_oncology": ["gu"], "breast_oncology": ["breast"], "gi_oncology": ["gastrointestinal"], "cns_oncology": ["cns"], "cutaneous_oncology": ["cutaneous"], "sarcoma_oncology": ["sarcoma"], "custom": []}
UNRESTRICTED_SPECIALTIES = ["all_oncology", "custom", "radiation_oncology"]
TITLE_STOPWORDS = ["with", "for", "and", "the", "from", "into", "plus", "upon", "after", "versus"]
NOT_ACRONYMS = ["ASCO", "ESMO", "ASTRO", "ASH", "AACR", "SABCS", "SITC", "FDA", "NCCN", "NEJM", "JCO", "JAMA", "BMJ", "RCT", "OS", "PFS", "DFS", "EFS", "ORR", "DCR", "PCR", "NSCLC", "SCLC", "GBM", "CLL", "AML", "CML", "MDS", "HR", "HER", "PDL", "MSI", "TMB"]
