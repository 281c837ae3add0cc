"""Clinical word lists, patterns and weights.

Every literal in this module is a fixed value that results depend on.  The
patterns are kept verbatim, including the ones that can never match because a
word boundary follows a truncated stem; correcting them would change rankings.
Patterns are matched case-insensitively unless noted.
"""

# --- fixed values: conditions (id, query pattern, on-topic, off-topic) -------

CONDITIONS = [
    ("meningitis",
     r"\bmeningitis\b|\bmeningococcal\b",
     r"\bmeningitis\b|\bmeningococcal\b",
     r"\brickettsia\b|\bmalaria\b(?!.*meningitis)"),
    ("malaria",
     r"\bmalaria\b|\bfalciparum\b|\bvivax\b|\bartemether\b|\bartesunate\b",
     r"\bmalaria\b|\bfalciparum\b|\bvivax\b|\bartemether\b|\bartesunate\b",
     r"\bmeningitis\b|\btuberculosis\b|\bpneumonia\b(?!.*malaria)"),
    ("tuberculosis",
     r"\btuberculosis\b|\b(?:ds-?|dr-?|mdr-?|xdr-?)?tb\b",
     r"\btuberculosis\b|\btb\b",
     r"\bmalaria\b|\bmeningitis\b(?!.*tb)"),
    ("asthma",
     r"\basthma\b|\bstatus asthmaticus\b",
     r"\basthma\b|\bstatus asthmaticus\b|\bbronchospasm\b",
     r"\bpneumonia\b|\bmalaria\b(?!.*asthma)"),
    ("sepsis",
     r"\bsepsis\b|\bseptic shock\b|\bbacteremia\b",
     r"\bsepsis\b|\bseptic\b|\bbacteremia\b",
     r"\bmalaria\b(?!.*sepsis)|\bmeningitis\b(?!.*sepsis)"),
    ("pneumonia",
     r"\bpneumonia\b",
     r"\bpneumonia\b",
     r"\btuberculosis\b|\bmalaria\b(?!.*pneumonia)|\basthma\b(?!.*pneumonia)"),
    ("eclampsia",
     r"\beclampsia\b|\bpre.?eclampsia\b",
     r"\beclampsia\b|\bpre.?eclampsia\b|\bmagnesium sulfate\b",
     None),
    ("malnutrition",
     r"\bmalnutrition\b|\bsam\b|\bRUTF\b|\bF-?75\b|\bF-?100\b",
     r"\bmalnutrition\b|\bRUTF\b|\bF-?75\b|\bF-?100\b|\bSAM\b",
     r"\bmalaria\b|\btuberculosis\b(?!.*nutrit)"),
    ("diarrhea",
     r"\bdiarr[ho]+ea?\b|\bORS\b|\boral rehydration\b",
     r"\bdiarr[ho]+ea?\b|\boral rehydration\b|\bORS\b",
     r"\bdysentery\b|\brickettsia\b"),
    ("dysentery",
     r"\bdysentery\b|\bshigella\b",
     r"\bdysentery\b|\bshigella\b|\bbloody.{0,20}stool\b",
     r"\brickettsia\b|\bdengue\b|\bophthalmia\b"),
    ("cholera",
     r"\bcholera\b|\bvibrio\b",
     r"\bcholera\b|\bvibrio\b",
     r"\brickettsia\b|\bmalaria\b"),
    ("dengue",
     r"\bdengue\b",
     r"\bdengue\b|\bNS1\b|\bhaematocrit\b|\bhematocrit\b|\bplatelet\b",
     r"\bcholera\b|\bsevere dehydration\b|\bORS\b(?!.*dengue)"),
    ("burns",
     r"\bburn(?:s|ed)?\b|\bthermal injury\b|\bTBSA\b|\bparkland\b",
     r"\bburn(?:s|ed)?\b|\bthermal injury\b|\bTBSA\b|\bparkland\b|\brule of 9s\b",
     r"\bdengue\b|\bdiarrh?oe?a\b|\bcholera\b|\bsevere dehydration\b"),
    ("buruli_ulcer",
     r"\bburuli\b|\bmycobacterium ulcerans\b",
     r"\bburuli\b|\bmycobacterium ulcerans\b|\bulcerans\b",
     r"\bscorpion\b|\bsnake\b|\benvenomation\b|\bPKDL\b"),
    ("podoconiosis",
     r"\bpodoconiosis\b",
     r"\bpodoconiosis\b|\bnon[- ]filarial elephantiasis\b",
     r"\blymphatic filariasis\b|\benvenomation\b|\bscorpion\b|\bsnake\b"),
    ("tungiasis",
     r"\btungiasis\b|\btunga penetrans\b",
     r"\btungiasis\b|\btunga penetrans\b|\bjigger\b",
     r"\bechinococcosis\b|\bPKDL\b|\benvenomation\b|\bscorpion\b|\bsnake\b"),
    ("noma",
     r"\bnoma\b|\bcancrum oris\b|\bnecroti[sz]ing gingivitis\b",
     r"\bnoma\b|\bcancrum oris\b|\bnecroti[sz]ing gingivitis\b|\boral gangrene\b",
     r"\bautism\b|\benvenomation\b|\bscorpion\b|\bsnake\b"),
    ("typhoid",
     r"\btyphoid\b|\benteric fever\b|\bsalmonella typhi\b",
     r"\btyphoid\b|\benteric fever\b|\bsalmonella typhi\b",
     r"\bophthalmia\b|\bconjunctivitis\b|\bneonat\w+\b"),
    ("sickle_cell",
     r"\bsickle\s*cell\b|\bacute chest syndrome\b|\bACS\b",
     r"\bsickle\s*cell\b|\bacute chest syndrome\b|\bvaso.?occlusive\b|\bhydroxyurea\b|\btransfusion\b",
     r"\bpneumonia\b(?!.*sickle)|\bophthalmia\b"),
    ("scorpion",
     r"\bscorpion(?:\s+(?:sting|envenomation))?\b",
     r"\bscorpion\b|\bsting\b|\benvenomation\b|\bantivenom\b",
     r"\bsnake\b"),
    ("hiv",
     r"\bHIV\b|\bART\b|\bantiretroviral\b|\bPMTCT\b",
     r"\bHIV\b|\bantiretroviral\b|\bARV\b",
     None),
    ("rabies",
     r"\brabies\b|\bpost.?exposure prophylaxis\b|\bPEP\b",
     r"\brabies\b|\bimmunoglobulin\b|\bvaccine\b|\bpost.?exposure\b",
     r"\bTB\b|\btuberculosis\b|\brifapentine\b|\bisoniazid\b"
     r"|\bmalaria\b|\bRTS,S\b|\bcasirivimab\b|\bimdevimab\b"),
    ("snakebite",
     r"\bsnake.?bite\b|\benvenomation\b|\bantivenom\b",
     r"\bsnake.?bite\b|\bsnake\b.{0,40}\b(?:antivenom|venom|bite|envenomation)\b"
     r"|\bpolyvalent\s+antivenom\b",
     r"\bscorpion\b"),
    ("tbi",
     r"\btraumatic brain\b|\btbi\b|\bhead injur\b",
     r"\brain injur\b|\bhead injur\b|\btbi\b",
     r"\bstroke\b(?!.*brain)"),
    ("hypertension",
     r"\bhypertension\b|\bhypertensiv(?:e|ion)\b|\bhypertensive emergency\b",
     r"\bhypertensiv\b|\bblood pressure\b|\blabetalol\b|\bhydralazine\b|\bamlodipine\b",
     r"\bmalaria\b|\bmeningitis\b"),
    ("anemia",
     r"\bana?emia\b|\bha?emoglobin\b|\btransfusion\b|\bpacked cells?\b",
     r"\bana?emia\b|\bha?emoglobin\b|\btransfusion\b|\bpacked cells?\b|\bwhole blood\b|\bblood transfusion\b",
     None),
    ("schistosomiasis",
     r"\bschistosomiasis\b|\bbilharzia\b|\bpraziquantel\b",
     r"\bschistosomiasis\b|\bbilharzia\b|\bpraziquantel\b|\bschistosome\b",
     r"\bmalaria\b|\bfilariasis\b"),
    ("appendicitis",
     r"\bappendicitis\b|\bappendectomy\b|\bappendicectomy\b",
     r"\bappendicitis\b|\bappendectomy\b|\bappendicectomy\b|\bperiappendic",
     r"\bcaesarean\b|\bcesarean\b|\boperative vaginal\b|\bvaginal birth\b|\blabou?r\b"),
    ("heart_failure",
     r"\bheart failure\b|\bcardiac failure\b|\bfurosemide\b",
     r"\bheart failure\b|\bcardiac failure\b|\bfurosemide\b|\bdiuretic\b|\bpulmonary oedema\b|\bpulmonary edema\b",
     None),
    ("depression",
     r"\bdepression\b|\bdepressive\b|\bssri\b|\bfluoxetine\b",
     r"\bdepression\b|\bdepressive\b|\bssri\b|\bfluoxetine\b|\bantidepressant\b|\bpsychological\b",
     None),
    ("psychosis",
     r"\bpsychosis\b|\bhaloperidol\b|\bpsychotic\b",
     r"\bpsychosis\b|\bhaloperidol\b|\bpsychotic\b|\bschizophrenia\b",
     None),
    ("pph",
     r"\bpostpartum hemorrhage\b|\bPPH\b|\boxytocin\b|\buterine atony\b",
     r"\bPPH\b|\buterine\b|\boxytocin\b|\bpostpartum.*bleed\b",
     None),
    ("ectopic",
     r"\bectopic pregnancy\b|\bectopic\b",
     r"\bectopic\b|\bfallopi\b",
     None),
]

# --- fixed values: topic coherence (id, query pattern, chunk pattern) --------

COHERENCE = [
    ("malaria",
     r"\b(?:malaria|plasmodium|artesunate|artemisinin)\b",
     r"\b(?:malaria|plasmodium|artemisinin|artesunate|quinine|chloroquine|falciparum|vivax|ACT)\b"),
    ("tuberculosis",
     r"\b(?:tuberculosis|TB\b|RHZE|isoniazid)\b",
     r"\b(?:tuberculosis|TB|isoniazid|rifampicin|rifampin|pyrazinamide|ethambutol|DOTS|mycobacterium|RHZE)\b"),
    ("sepsis",
     r"\b(?:sepsis|septic\s+shock)\b",
     r"\b(?:sepsis|septic|bacteremia|bacteraemia|vasopressor|blood\s+culture|broad.spectrum)\b"),
    ("anaphylaxis",
     r"\b(?:anaphylaxis|anaphylactic)\b",
     r"\b(?:anaphylaxis|anaphylactic|epinephrine|adrenaline|urticaria|angioedema|allergic)\b"),
    ("meningitis",
     r"\b(?:meningitis)\b",
     r"\b(?:meningitis|cerebrospinal|CSF|lumbar|ceftriaxone|dexamethasone|meningococcal)\b"),
    ("dengue",
     r"\b(?:dengue)\b",
     r"\b(?:dengue|NS1|platelet|haematocrit|hematocrit)\b"),
    ("cholera",
     r"\b(?:cholera|vibrio)\b",
     r"\b(?:cholera|vibrio|rice[- ]water stool|acute watery diarrh|ORS|Ringer.s lactate|doxycycline|azithromycin)\b"),
    ("burns",
     r"\b(?:burn(?:s|ed)?|thermal injury|TBSA|parkland)\b",
     r"\b(?:burn(?:s|ed)?|thermal injury|TBSA|parkland|rule of 9s|lund[- ]browder|dressing|silver sulfadiazine)\b"),
    ("rabies",
     r"\b(?:rabies|post.?exposure prophylaxis|PEP)\b",
     r"\b(?:rabies|immunoglobulin|vaccine|post.?exposure|bite wound)\b"),
    ("anemia",
     r"\b(?:ana?emia|ha?emoglobin|transfusion)\b",
     r"\b(?:ana?emia|ha?emoglobin|transfusion|packed cells?|whole blood|blood transfusion|iron)\b"),
    ("hypertension",
     r"\b(?:hypertension|hypertensive)\b",
     r"\b(?:hypertension|hypertensive|blood pressure|labetalol|hydralazine|amlodipine|thiazide|ace inhibitor)\b"),
    ("schistosomiasis",
     r"\b(?:schistosomiasis|bilharzia|praziquantel)\b",
     r"\b(?:schistosomiasis|bilharzia|praziquantel|schistosome|helminth)\b"),
    ("appendicitis",
     r"\b(?:appendicitis|appendectomy|appendicectomy)\b",
     r"\b(?:appendicitis|appendectomy|appendicectomy|periappendic)\b"),
    ("heart_failure",
     r"\b(?:heart failure|cardiac failure|furosemide)\b",
     r"\b(?:heart failure|cardiac failure|furosemide|diuretic|pulmonary oedema|pulmonary edema)\b"),
    ("depression",
     r"\b(?:depression|depressive|ssri|fluoxetine)\b",
     r"\b(?:depression|depressive|ssri|fluoxetine|antidepressant|psychological)\b"),
    ("buruli_ulcer",
     r"\b(?:buruli|mycobacterium ulcerans)\b",
     r"\b(?:buruli|mycobacterium ulcerans|ulcerans|rifampicin|streptomycin|clarithromycin|wound care)\b"),
    ("podoconiosis",
     r"\b(?:podoconiosis)\b",
     r"\b(?:podoconiosis|non[- ]filarial elephantiasis|foot hygiene|compression|lymphoedema)\b"),
    ("tungiasis",
     r"\b(?:tungiasis|tunga penetrans|jigger)\b",
     r"\b(?:tungiasis|tunga penetrans|jigger|flea extraction|wound care|secondary infection)\b"),
    ("noma",
     r"\b(?:noma|cancrum oris|necroti[sz]ing gingivitis)\b",
     r"\b(?:noma|cancrum oris|necroti[sz]ing gingivitis|metronidazole|debridement|oral hygiene)\b"),
    ("eclampsia",
     r"\b(?:eclampsia|pre.?eclampsia)\b",
     r"\b(?:eclampsia|magnesium|labetalol|hydralazine|pre.eclampsia|hypertensive)\b"),
    ("dysentery",
     r"\b(?:dysentery|bloody\s+diarrh?oea|shigella)\b",
     r"\b(?:dysentery|shigella|ciprofloxacin|azithromycin|bloody\s+stool|acute\s+diarr?hoea)\b"),
    ("typhoid",
     r"\b(?:typhoid|enteric\s+fever|salmonella\s+typhi)\b",
     r"\b(?:typhoid|enteric\s+fever|salmonella\s+typhi|blood\s+culture|widal|ciprofloxacin|ceftriaxone)\b"),
    ("sickle_cell",
     r"\b(?:sickle\s*cell|acute\s+chest\s+syndrome|ACS)\b",
     r"\b(?:sickle\s*cell|acute\s+chest\s+syndrome|vaso.?occlusive|hydroxyurea|transfusion|HbS)\b"),
    ("cardiac_arrest",
     r"\b(?:cardiac\s+arrest|cardiopulmonary\s+resuscitation|AED)\b",
     r"\b(?:cardiac\s+arrest|CPR|defibrillat|compressions?|AED|resuscitat|adrenaline|epinephrine|atropine|airway)\b"),
    ("snakebite",
     r"\b(?:snake.?bite|snake\s+(?:venom|envenomation)|snakebite)\b",
     r"\b(?:antivenom|snake\s+(?:bite|venom)|polyvalent|antitoxin)\b"),
    ("scorpion",
     r"\b(?:scorpion(?:\s+(?:sting|envenomation))?)\b",
     r"\b(?:scorpion|sting|envenomation|antivenom|analgesic)\b"),
    ("neonatal_sepsis",
     r"\b(?:neonatal|newborn)\b.{0,60}\b(?:sepsis|infection|bacteremia|antibiotic)\b",
     r"\b(?:sepsis|septic|ampicillin|gentamicin|bacteremia|bacteraemia|neonatal\s+(?:sepsis|infection))\b"),
    ("malnutrition",
     r"\b(?:severe\s+acute\s+malnutrition|SAM\b|RUTF|marasmus|kwashiorkor)\b",
     r"\b(?:malnutrition|RUTF|kwashiorkor|marasmus|F-75|F-100|therapeutic\s+feeding|wasting|MUAC|undernutrition)\b"),
]

# --- fixed values: exclusions (id, query pattern, chunk pattern, factor) -----

TITLE_EXCLUSIONS = [
    ("meningitis", r"\b(?:meningitis|meningococcal)\b", r"\bpneumonia\b", 0.60),
    ("pneumonia", r"\b(?:pneumonia|community.acquired\s+pneumonia)\b", r"\bmeningitis\b", 0.60),
    ("skin_ntd",
     r"\b(?:buruli|podoconiosis|tungiasis|noma|cancrum oris|necroti[sz]ing gingivitis)\b",
     r"\b(?:scorpion|snake|envenomation|echinococcosis|PKDL)\b", 0.60),
    ("dysentery",
     r"\b(?:dysentery|shigella|bloody\s+diarrh?oe?a)\b",
     r"\b(?:sexual assault|sti|sexually transmitted|post.?exposure prophylaxis)\b", 0.60),
    ("rabies",
     r"\b(?:rabies|post.?exposure prophylaxis|PEP)\b",
     r"\b(?:TB|tuberculosis|rifapentine|isoniazid)\b", 0.60),
    ("dengue",
     r"\b(?:dengue)\b",
     r"\b(?:if intravenous treatment|plan c|severe dehydration|if there is high fever|when to stop vasopressors)\b",
     0.60),
    ("burns",
     r"\b(?:burn(?:s|ed)?|thermal injury|TBSA|parkland)\b",
     r"\b(?:severe dehydration|if there is high fever|children under 2 months)\b", 0.60),
    ("snakebite", r"\b(?:snake.?bite|antivenom)\b", r"\bscorpion\b", 0.60),
]

TITLE_OVERRIDES = [
    ("meningitis", r"\b(?:meningitis|meningococcal)\b", r"\bpneumonia\b", 0.35),
    ("pneumonia", r"\b(?:pneumonia|community.acquired\s+pneumonia)\b", r"\bmeningitis\b", 0.35),
]

CONTENT_EXCLUSIONS = [
    ("dysentery",
     r"\b(?:dysentery|shigella|bloody\s+diarrh?oe?a)\b",
     r"\b(?:sexual assault|sexually transmitted|post.?exposure prophylaxis"
     r"|sex transm infect|hiv pep|pelvic inflammatory disease|lower abdominal pain"
     r"|gonorrhoeae|trachomatis|vaginosis)\b", 0.12),
    ("typhoid",
     r"\b(?:typhoid|enteric\s+fever|salmonella\s+typhi)\b",
     r"\b(?:ophthalmia|conjunctivitis|eye drops?|neonat\w+|sex transm infect)\b", 0.10),
]

CONTENT_EXCLUSIONS_V1 = [
    ("dysentery",
     r"\b(?:dysentery|shigella|bloody\s+diarrh?oe?a)\b",
     r"\b(?:sexual assault|sexually transmitted|post.?exposure prophylaxis"
     r"|sex transm infect|hiv pep)\b", 0.20),
]

# --- fixed values: query synonyms --------------------------------------------

SYNONYMS = [
    ("adrenaline", ["epinephrine"]),
    ("epinephrine", ["adrenaline"]),
    ("MgSO4", ["magnesium sulfate"]),
    ("magnesium sulfate", ["MgSO4"]),
    ("paracetamol", ["acetaminophen"]),
    ("acetaminophen", ["paracetamol"]),
    ("PPH", ["postpartum hemorrhage", "postpartum haemorrhage"]),
    ("DKA", ["diabetic ketoacidosis"]),
    ("norepinephrine", ["noradrenaline", "vasopressor"]),
    ("noradrenaline", ["norepinephrine", "vasopressor"]),
    ("ACT", ["artemisinin combination therapy"]),
    ("amoxycillin", ["amoxicillin"]),
    ("rifampicin", ["rifampin"]),
    ("rifampin", ["rifampicin"]),
    ("cotrimoxazole", ["TMP-SMX", "trimethoprim"]),
    ("dysentery", ["Shigella", "ciprofloxacin"]),
    ("antivenom", ["envenomation", "snake bite"]),
    ("envenomation", ["antivenom", "snake bite"]),
    ("SAM", ["severe acute malnutrition", "RUTF"]),
    ("RUTF", ["therapeutic feeding", "severe acute malnutrition"]),
    ("haloperidol", ["antipsychotic", "psychosis"]),
    ("resuscitation", ["airway breathing circulation"]),
    ("artemether", ["ACT", "lumefantrine"]),
    ("lumefantrine", ["artemether", "ACT"]),
    ("oxytocin", ["uterotonic"]),
    ("misoprostol", ["uterotonic"]),
    ("tamponade", ["balloon tamponade", "uterine balloon"]),
    ("vaccine", ["vaccination", "immunisation"]),
    ("vaccination", ["vaccine", "immunisation"]),
    ("immunisation", ["vaccine", "vaccination"]),
    ("anemia", ["anaemia"]),
    ("anaemia", ["anemia"]),
    ("labour", ["labor"]),
    ("labor", ["labour"]),
    ("schistosomiasis", ["bilharzia", "praziquantel"]),
    ("praziquantel", ["schistosomiasis", "bilharzia"]),
    ("hepatotoxicity", ["DILI", "drug-induced liver injury"]),
]

# terms of the first-generation synonym list
SYNONYM_TERMS_V1 = [
    "adrenaline", "epinephrine", "MgSO4", "magnesium sulfate", "paracetamol",
    "acetaminophen", "PPH", "DKA", "norepinephrine", "noradrenaline", "ACT",
    "amoxycillin", "rifampicin", "rifampin", "cotrimoxazole", "dysentery",
    "antivenom", "envenomation", "SAM", "haloperidol", "resuscitation",
]

# --- fixed values: content-type weights --------------------------------------

TYPE_WEIGHTS = {
    "recommendation": 1.50, "treatment_protocol": 1.50, "dosage": 1.50,
    "obstetric_protocol": 1.50, "tb_regimen": 1.50, "implementation": 1.30,
    "drug_monograph": 1.30, "referral_criteria": 1.30, "diagnostic": 1.15,
    "prevention": 1.30, "general_clinical": 1.00, "table": 1.00,
    "patient_assessment": 1.00, "monitoring": 1.10, "counselling": 1.00,
    "executive_summary": 1.00, "disease_entry": 1.00, "clinical_features": 1.00,
    "evidence_summary": 0.60, "etd": 0.60, "remarks": 0.60, "rationale": 0.50,
    "methods_pico": 0.45, "methodology": 0.45, "epidemiology": 0.40,
    "scope": 0.25, "annex": 0.25, "background": 0.20, "research_gap": 0.15,
}

TYPE_WEIGHTS_V1 = {
    "dosage_table": 1.50, "treatment_protocol": 1.40, "danger_signs": 1.40,
    "recommendation": 1.30, "imci_classification": 1.30, "fluid_rehydration": 1.30,
    "diagnostic_criteria": 1.20, "adverse_effects": 1.10, "monitoring_schedule": 1.05,
    "contraindication": 1.10, "drug_interaction": 1.10, "regular": 1.00,
    "programme_table": 0.75, "evidence_profile": 0.20, "evidence_to_decision": 0.10,
}

ACTION_TYPES = [
    "recommendation", "implementation", "treatment_protocol", "dosage",
    "drug_monograph", "obstetric_protocol", "tb_regimen", "referral_criteria",
    "diagnostic", "prevention",
]
CONTEXT_TYPES = [
    "etd", "methods_pico", "background", "research_gap", "annex", "scope",
    "evidence_summary", "methodology", "epidemiology", "rationale", "remarks",
]
ACTION_TYPES_V1 = [
    "dosage_table", "treatment_protocol", "danger_signs", "recommendation",
    "imci_classification", "fluid_rehydration",
]
CONTEXT_TYPES_V1 = ["recommendation", "diagnostic_criteria", "programme_table"]
STRICT_TYPES_V1 = ["dosage_table", "treatment_protocol", "danger_signs", "recommendation"]
EVIDENCE_TYPES_V1 = ["evidence_profile", "evidence_to_decision"]
COMPONENT_TYPES_V1 = ["dosage_table", "treatment_protocol"]

TASK_TYPES = {
    "dose": ["recommendation", "implementation", "dosage", "treatment_protocol",
             "drug_monograph", "tb_regimen", "obstetric_protocol"],
    "diagnosis": ["recommendation", "diagnostic", "clinical_features", "patient_assessment"],
    "first_line": ["recommendation", "implementation", "treatment_protocol",
                   "drug_monograph", "tb_regimen"],
    "referral": ["recommendation", "implementation", "referral_criteria"],
    "prevention": ["recommendation", "prevention", "counselling"],
}
TASK_TYPES_V1 = {
    "dose": ["dosage_table", "treatment_protocol"],
    "diagnosis": ["diagnostic_criteria", "danger_signs", "imci_classification"],
    "first_line": ["treatment_protocol", "dosage_table", "recommendation"],
    "referral": ["treatment_protocol", "recommendation", "danger_signs"],
    "prevention": ["recommendation"],
}

# --- fixed values: action intent ---------------------------------------------

ACTION_DOSE = (
    r"\b(?:dose|dosage|mg|mcg|units?|administer|prescri(?:be|ption)"
    r"|infusion|IV\b|IM\b|PO\b|antibiotic|antifungal|antiviral"
    r"|vasopressor|first.?line|empiric(?:al)?|regimen"
    r"|oxytocin|misoprostol|uterotonic|artemether|lumefantrine"
    r"|vaccine|vaccination|antihypertensive|transfusion|tamponade"
    r"|praziquantel|labetalol|uterine balloon|rutf|therapeutic feeding)\b"
)
ACTION_DOSE_V1 = (
    r"\b(?:dose|dosage|mg|mcg|units?|administer|prescri(?:be|ption)"
    r"|infusion|IV\b|IM\b|PO\b|antibiotic|antifungal|antiviral"
    r"|vasopressor|first.?line|empiric(?:al)?|regimen)\b"
)
ACTION_TASK = (
    r"\b(?:treat(?:ment|ing)?|manage(?:ment)?|protocol|guideline|algorithm"
    r"|first.?line|empiric(?:al)?|referral|transfer|stabiliz(?:e|ation)"
    r"|pre.?referral|prevention|prophylax(?:is)?)\b"
)
ACTION_CONDITION = (
    r"\b(?:treat(?:ment|ing)?|manage(?:ment)?|protocol"
    r"|sepsis|malaria|tuberculosis|TB\b|meningitis|pneumonia"
    r"|eclampsia|pre.?eclampsia|DKA|ketoacidosis|anaphylaxis"
    r"|haemorrhage|hemorrhage|PPH|shock|stroke|infection"
    r"|rabies|snake.?bite|hypertension|ana?emia|schistosomiasis"
    r"|appendicitis|heart failure|depression|malnutrition"
    r"|podoconiosis|tungiasis|noma"
    r"|how\s+to\s+treat|how\s+to\s+manage"
    r"|emergency|acute\s+(?:management|treatment)|severe|critical\s+(?:illness|care)"
    r"|hypertensive\s+(?:emergency|crisis)|airway|resuscitation|cardiac\s+arrest)\b"
)
ACTION_CONDITION_V1 = (
    r"\b(?:treat(?:ment|ing)?|manage(?:ment)?|protocol"
    r"|sepsis|malaria|tuberculosis|TB\b|meningitis|pneumonia"
    r"|eclampsia|pre.?eclampsia|DKA|ketoacidosis|anaphylaxis"
    r"|haemorrhage|hemorrhage|PPH|shock|stroke|infection"
    r"|how\s+to\s+treat|how\s+to\s+manage"
    r"|emergency|acute\s+(?:management|treatment)|severe|critical\s+(?:illness|care)"
    r"|hypertensive\s+(?:emergency|crisis)|airway|resuscitation|cardiac\s+arrest)\b"
)

# --- fixed values: text signals ----------------------------------------------

DOSE_NUMBER = (
    r"\b\d+(?:\.\d+)?\s*(?:mg|mcg|µg|mmol|mL|ml|g/kg|mg/kg|mcg/kg|IU|units?|%)\b"
    r"|\b\d+(?:\.\d+)?\s*(?:mcg|µg)/(?:kg/)?min\b"
)
ROUTE_ADMIN = (
    r"\b(?:IV\b|IM\b|PO\b|SC\b|oral(?:ly)?|intravenous|intramuscular"
    r"|subcutaneous|infusion|injection)\b"
)
FREQUENCY = (
    r"\b(?:daily|twice|q\d+[-–]?\d*h?|every\s+\d+(?:\s*[-–]\s*\d+)?\s*h(?:ours?)?"
    r"|stat\b|TID|BID|QID|q8h|q6h|q12h|once\s+daily|four\s+times)\b"
)
PROTOCOL_TEXT = (
    r"\b(?:recommend(?:ed|ation)?|first.?line|regimen|dos(?:e|age)"
    r"|mg(?:/kg)?|IV\b|IM\b|oral|administer|give|refer|referral"
    r"|danger signs?|monitor(?:ing)?|algorithm|protocol)\b"
)
RESCUE_RECOMMEND = (
    r"(?:(?<!not\s)\brecommend(?:ed|ation)?\b|\bshould\b|\bmust\b|\badminister\b|\bgive\b|\btreat\b"
    r"|first.?line|preferred|indicated)\b"
)
CORRUPTION = (
    r"·i\b|recursively\b|>loc[_\s]\d+|\blocas\b"
    r"|smoker,\s+and\s+a\s+person\s+who\s+is\s+not\s+smoking"
    r"|ganges\s+river"
    r"|methanibutol|diploplohydria|hydratraemia|hypokatropaenia"
)
CORRUPTION_FEDERATED = r"·i\b|recursively\b|>loc[_\s]\d+|\blocas\b"
CORRUPTION_SOFT = r"\b(?:AND OR|OR RF|maximum\s+maximum)\b"

# --- fixed values: population -------------------------------------------------

PAEDIATRIC_QUERY = (
    r"\b(?:child(?:ren)?|infant|neonate|neonatal|paediatric|pediatric"
    r"|newborn|under.?5|under.?one)\b"
)
OBSTETRIC_QUERY = (
    r"\b(?:pregnan|obstetric|maternal|postpartum|eclampsia|labour|labor"
    r"|antenatal|postnatal|PPH|placenta|foetal|fetal|neonatal)\b"
)
ADULT_NON_OBSTETRIC = (
    r"\b(?:DKA|diabetic\s+ketoacidosis|stroke\b|pulmonary\s+embolism\b"
    r"|cardiac\s+arrest|myocardial\s+infarction|septic\s+shock)\b"
)
OBSTETRIC_FILES = ["MSF_OBG.pdf"]
PAEDIATRIC_FILES = []
PAEDIATRIC_FILES_V1 = ["WHO_Guide_childrencare.pdf"]

POP_ADULT_QUERY = r"\badult\b|\bwoman\b|\bwomen\b|\bpregnant\b|\bmaternal\b"
POP_CHILD_QUERY = r"\bchild(?:ren)?\b|\bpediatric\b|\bpaediatric\b|\bunder.?5\b"
POP_NEONATE_QUERY = r"\bneonatal\b|\bnewborn\b|\bneonate\b"
POP_NEONATE_CHUNK = (
    r"\bchildren under \d\b|\bneonatal\b|\bunder 2 months\b|\bnewborn\b|\bneonate\b"
)
POP_CHILD_CHUNK = r"\bchild(?:ren)?\b|\bpediatric\b|\bpaediatric\b|\bunder.?5\b|\binfant\b"
POP_ADULT_CHUNK = r"\badult\b|\bpatients?.{0,10}(?:aged?|over) \d{2}"

# --- fixed values: severity ---------------------------------------------------

SEVERITY_LIGHT_QUERY = (
    r"\buncomplicated\b|\bsimple\b|\bmild\b"
    r"|\bds[- ]?tb\b|\bdrug[- ]?sensitive\b|\bfirst.?line oral\b|\boutpatient\b"
)
SEVERITY_HEAVY_QUERY = (
    r"\bsevere\b|\bcritical\b|\bshock\b|\bICU\b|\bintensive care\b|\bemergency\b"
)
SEVERITY_HEAVY_CHUNK = r"(?<!un)\bcomplicated\b|\bsevere\b|\bcritical\b|\bshock\b"
SEVERITY_LIGHT_CHUNK = (
    r"\buncomplicated\b|\boral.{0,20}(?:treatment|therapy)\b|\boutpatient\b"
)
SENSITIVE_TB_QUERY = r"\bds[- ]?tb\b|\bdrug[- ]?sensitive\b"
RESISTANT_TB_CHUNK = (
    r"\bdrug[- ]?resistant\b|\bmdr[- ]?tb\b|\bxdr[- ]?tb\b"
    r"|\bbedaquiline\b|\bpretomanid\b|\blinezolid\b"
)

# --- fixed values: task (first match wins) -------------------------------------

TASKS = [
    ("dose", r"\bdose\b|\bdosage\b|\bmg(?:/kg)?\b|\bregimen\b|\badminister\b|\binfusion\b|\bhow much\b"),
    ("diagnosis", r"\bdiagnos(?:e|is|tic)\b|\bcriteria\b|\bsigns?\b|\bdifferential\b|\bidentif\b"),
    ("first_line", r"\bfirst.?line\b|\bempiric\b|\binitial treatment\b"),
    ("referral", r"\breferral\b|\bwhen to refer\b|\bbefore referral\b|\btransfer\b"),
    ("prevention", r"\bprevention\b|\bprophylax\b|\bprevent\b|\bvaccin\b"),
]

# --- fixed values: special queries and chunks ----------------------------------

CHEST_SYNDROME_QUERY = r"\b(?:acute\s+chest\s+syndrome|ACS)\b"
CHEST_SYNDROME_CHUNK = (
    r"\b(?:acute\s+chest\s+syndrome|ACS|hypox(?:ia|emic)|chest pain|respiratory distress)\b"
)
TREATMENT_COMPONENT = (
    r"\b(?:vasopressor|norepinephrine|noradrenaline|epinephrine|adrenaline"
    r"|dopamine|dobutamine|ceftriaxone|ciprofloxacin|amoxicillin|dose|dosage"
    r"|mg(?:/kg)?|infusion|iv\b|im\b|oral|oxytocin|misoprostol|artemether"
    r"|lumefantrine|vaccine|transfusion|tamponade|praziquantel|labetalol)\b"
)
TREATMENT_COMPONENT_V1 = (
    r"\b(?:vasopressor|norepinephrine|noradrenaline|epinephrine|adrenaline"
    r"|dopamine|dobutamine|ceftriaxone|ciprofloxacin|amoxicillin|dose|dosage"
    r"|mg(?:/kg)?|infusion|iv\b|im\b|oral)\b"
)
SCORPION_CHUNK = r"\bscorpion\b"
RABIES_CONFUSERS = r"\bmalaria\b|\bRTS,S\b|\bcasirivimab\b|\bimdevimab\b"

WEAK_TITLE_V1 = (
    r"^(?:remarks?|symptomatic\s+treatment|additional\s+considerations?"
    r"|examples?|harms?|further\s+information"
    r"|\d{4}$"
    r"|[A-Z]\.\s+\w{1,8}$"
    r"|\d+[\.\)]\s*(?:if|in|for|when|the|a)\b"
    r")"
)
BARE_HEADING_V1 = (
    r"^\s*(?:chapter\s+\d+[:.]?|recommendations?|new\s+recommendation"
    r"|summary|conclusion|background|introduction|foreword|footnotes?"
    r"|second edition|©\s*world health organization.*)\s*$"
)
ANNEX_TITLE_V1 = (
    r"^\s*(?:annex|appendix|table of|list of|summary of changes|change.*summary)"
)
GENERIC_TITLE_V1 = (
    r"^\s*(?:\d+[\.\)]\s*)?(?:chapter\s+\d+[:.]?\s*)?"
    r"(?:management|monitoring|recommendations?|evidence"
    r"|recommendation and supporting evidence|background|approach|assessment"
    r"|recommendations?\s+and\s+evidence)"
    r"(?:\s*\(page\s*\d+/\d+\))?\s*$"
)
NOISE_TITLE_V1 = (
    r"^\s*(?:8\.\s*violence and injury prevention"
    r"|emergency tr(?:i| )age assessment and treatment"
    r"|4\.\s*severe dehydration|second edition)\s*$"
)

# --- fixed values: chunk metadata ----------------------------------------------

INLINE_FIELDS = [
    "title", "uri", "track", "tags", "labels", "chunk_id", "content_hash",
    "content_type", "doc_type", "docling_provenance", "extractous_metadata",
    "headings", "is_current", "pdf_file", "retrieval_priority", "source_url",
    "token_count", "page_numbers",
]
METADATA_LINES = [
    "title: ", "uri: mv2://", "tags: ", "labels: ", "chunk_id: ",
    "content_type: ", "memvid.embedding.", "memvid.", "docling_provenance:",
    "doc_type: ", "source_url: ", "is_current: ", "retrieval_priority: ",
    "token_count: ", "content_hash: ", "extractous_metadata:", "headings:",
    "pdf_file:", "page_numbers:", "track: ", "tags:", "labels:", "chunk_id:",
    "content_hash:", "source: lex", "source: sem", "source: rrf",
]
METADATA_LINES_V1 = [
    "title: ", "uri: mv2://", "tags: ", "labels: ", "chunk_id: ",
    "content_type: ", "extractous_metadata:", "memvid.embedding.",
    "page_numbers:", "pdf_file:", "headings:", "hierarchy_level:", "memvid.",
]

# --- fixed values: differences of the federated vocabulary ----------------------

FEDERATED_CONDITIONS_DROPPED = [
    "dengue", "burns", "buruli_ulcer", "podoconiosis", "tungiasis", "noma",
    "typhoid", "sickle_cell", "scorpion", "rabies",
]
V1_CONDITIONS_DROPPED = [
    "anemia", "schistosomiasis", "appendicitis", "heart_failure", "depression",
]
V1_CONDITION_CHANGES = {
    "typhoid": (
        r"\btyphoid\b|\benteric fever\b|\bsalmonella typhi\b",
        r"\btyphoid\b|\benteric fever\b|\bsalmonella typhi\b|\bceftriaxone\b|\bazithromycin\b",
        r"\bophthalmia\b|\bconjunctivitis\b|\bneonat\w+\b"),
    "hypertension": (
        r"\bhypertensiv[e ]\b|\bhypertensive emergency\b",
        r"\bhypertensiv\b|\bblood pressure\b",
        r"\bmalaria\b|\bmeningitis\b"),
}
FEDERATED_CONDITION_CHANGES = {
    "hiv": (
        r"\bHIV\b|\bPEP\b(?!.*TB)|\bART\b|\bantiretroviral\b|\bPMTCT\b",
        r"\bHIV\b|\bPEP\b|\bantiretroviral\b|\bARV\b",
        None),
    "snakebite": (
        r"\bsnake.?bite\b|\benvenomation\b|\bantivenom\b",
        r"\bsnake.?bite\b|\benvenomation\b|\bantivenom\b",
        None),
}
V1_COHERENCE_DROPPED = [
    "anemia", "hypertension", "schistosomiasis", "appendicitis", "heart_failure",
    "depression", "typhoid", "sickle_cell",
]
FEDERATED_COHERENCE = [
    "malaria", "tuberculosis", "sepsis", "anaphylaxis", "meningitis", "dengue",
    "eclampsia", "dysentery", "cardiac_arrest", "envenomation",
    "neonatal_sepsis", "malnutrition",
]
ENVENOMATION_COHERENCE = (
    "envenomation",
    r"\b(?:envenomation|antivenom|scorpion\s+sting|snake\s+(?:bite|venom))\b",
    r"\b(?:antivenom|envenomation|snake|scorpion|venom|neostigmine|polyvalent|antitoxin)\b",
)
FAILOVER_THRESHOLDS = {"bm25": 5.0, "sem": 0.05, "rrf": 0.020}
PRIMARY_SOURCE = "WHO Guidelines"
SECONDARY_SOURCE = "WikiMed"
