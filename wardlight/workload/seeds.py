"""Clinical phrases mixed into the driver's texts, which are invented words.

Each document gets the chunk seed number ``doc_id % len(CHUNKS)`` and each
benchmark item the query seed number ``item_id % len(QUERIES)``, in front of its
whole text, so that the clinical rules have something to act on.
"""

# title, sentence, content type, first-generation content type, file
CHUNKS = [
    ("Malaria > Severe malaria", "Give artesunate 2.4 mg/kg IV every 12 hours for severe malaria in adult patients.", "recommendation", "treatment_protocol", "malaria.pdf"),
    ("Malaria > Uncomplicated", "Uncomplicated malaria: oral artemether therapy twice daily, outpatient care.", "dosage", "dosage_table", "malaria.pdf"),
    ("Malaria > Background", "Malaria is transmitted widely; falciparum should be treated with oral artesunate 100 mg daily.", "background", "regular", "malaria.pdf"),
    ("Meningitis > Treatment", "Meningitis: ceftriaxone 2 g IV infusion, malaria may mimic meningitis.", "treatment_protocol", "treatment_protocol", "meningitis.pdf"),
    ("Meningitis and pneumonia", "Pneumonia may accompany meningitis; lumbar puncture is recommended.", "diagnostic", "diagnostic_criteria", "meningitis.pdf"),
    ("Pneumonia > Children", "Pneumonia in children under 5: oral amoxicillin 40 mg/kg twice daily.", "recommendation", "recommendation", "childcare.pdf"),
    ("Tuberculosis > Drug-sensitive", "Tuberculosis regimen RHZE with isoniazid and rifampicin daily.", "tb_regimen", "treatment_protocol", "tb.pdf"),
    ("Tuberculosis > Resistant", "Drug-resistant tuberculosis needs bedaquiline and linezolid.", "drug_monograph", "dosage_table", "tb.pdf"),
    ("Eclampsia > Magnesium", "Eclampsia: magnesium sulfate 4 g IV, then monitor blood pressure; labetalol if hypertensive.", "obstetric_protocol", "treatment_protocol", "MSF_OBG.pdf"),
    ("Postpartum haemorrhage", "PPH: oxytocin 10 IU IM for the woman, postpartum bleed, uterine massage.", "obstetric_protocol", "treatment_protocol", "MSF_OBG.pdf"),
    ("Sepsis > Neonatal", "Neonatal sepsis: ampicillin and gentamicin injection for the newborn.", "recommendation", "danger_signs", "newborn.pdf"),
    ("Sepsis > Septic shock", "Septic shock: norepinephrine infusion, blood culture, critical care.", "implementation", "recommendation", "sepsis.pdf"),
    ("Dengue > Severe dehydration", "Dengue: watch haematocrit and platelet count; ORS by mouth.", "clinical_features", "danger_signs", "dengue.pdf"),
    ("Cholera", "Cholera: rice-water stool, ORS and doxycycline, severe dehydration.", "treatment_protocol", "fluid_rehydration", "cholera.pdf"),
    ("Burns > Fluids", "Burns: parkland formula by TBSA, dressing with silver sulfadiazine.", "recommendation", "fluid_rehydration", "burns.pdf"),
    ("Rabies > Prophylaxis", "Rabies post-exposure prophylaxis: vaccine and immunoglobulin at the bite wound; malaria vaccine RTS,S is separate.", "prevention", "recommendation", "rabies.pdf"),
    ("Tuberculosis preventive PEP", "Isoniazid and rifapentine for contacts; refer those with signs.", "counselling", "regular", "tb.pdf"),
    ("Snakebite", "Snake bite: polyvalent antivenom IV, monitor airway.", "recommendation", "treatment_protocol", "venom.pdf"),
    ("Scorpion sting", "Scorpion sting: antivenom for snake or scorpion envenomation, analgesic.", "recommendation", "treatment_protocol", "venom.pdf"),
    ("Sickle cell disease", "Sickle cell: transfusion and hydroxyurea; pneumonia is common.", "disease_entry", "regular", "sickle.pdf"),
    ("Acute chest syndrome", "Acute chest syndrome in sickle cell: hypoxia, chest pain, transfusion.", "recommendation", "danger_signs", "sickle.pdf"),
    ("Dysentery", "Dysentery by shigella: ciprofloxacin for bloody diarrhoea with bloody stool.", "treatment_protocol", "treatment_protocol", "gut.pdf"),
    ("Sexual assault care", "After sexual assault: post-exposure prophylaxis, lower abdominal pain, HIV PEP and shigella advice.", "table", "programme_table", "sti.pdf"),
    ("Typhoid", "Typhoid: enteric fever, azithromycin orally; neonates with ophthalmia or conjunctivitis differ.", "dosage", "dosage_table", "gut.pdf"),
    ("Malnutrition > SAM", "Severe acute malnutrition: RUTF, F-75 then F-100, measure MUAC.", "recommendation", "imci_classification", "nutrition.pdf"),
    ("Annex 3", "Annex with evidence tables on malaria and sepsis.", "annex", "evidence_profile", "malaria.pdf"),
    ("Research gaps", "Research gap: trials of artesunate in pregnancy.", "research_gap", "evidence_to_decision", "malaria.pdf"),
    ("Scope", "Scope of the guideline on tuberculosis.", "scope", "evidence_profile", "tb.pdf"),
    ("Methods", "PICO methods for pneumonia and asthma questions.", "methods_pico", "evidence_to_decision", "childcare.pdf"),
    ("Evidence to decision", "Evidence on meningitis vaccine values.", "etd", "evidence_profile", "meningitis.pdf"),
    ("Hypertension", "Hypertension: amlodipine orally; hypertensive emergency needs labetalol; blood pressure daily.", "recommendation", "recommendation", "heart.pdf"),
    ("Heart failure", "Heart failure: furosemide, diuretic, pulmonary oedema.", "monitoring", "monitoring_schedule", "heart.pdf"),
    ("Anaemia", "Anaemia: transfusion of packed cells below haemoglobin 5 g/dL; iron.", "recommendation", "regular", "blood.pdf"),
    ("Depression", "Depression: fluoxetine 20 mg once daily; psychological care.", "drug_monograph", "dosage_table", "mind.pdf"),
    ("Appendicitis", "Appendicitis: appendectomy; in labour think of caesarean.", "referral_criteria", "regular", "surgery.pdf"),
    ("Stroke and brain injury", "Traumatic brain injury tbi: airway; stroke of the brain differs; cardiac arrest CPR.", "general_clinical", "regular", "neuro.pdf"),
    ("Buruli and noma", "Buruli ulcer: rifampicin and clarithromycin; noma: metronidazole; snake and scorpion wounds differ.", "recommendation", "treatment_protocol", "skin.pdf"),
    ("Extraction noise", "maximum maximum AND OR malaria dose table.", "table", "programme_table", "malaria.pdf"),
    ("Broken page", "The ganges river recursively shows methanibutol.", "recommendation", "treatment_protocol", "malaria.pdf"),
    ("Remarks", "It is not recommended to delay; asthma and bronchospasm respond to treatment.", "background", "regular", "asthma.pdf"),
    ("Background", "Malaria facts.", "background", "regular", "WHO_Guide_childrencare.pdf"),
    ("Management", "Continue as before and refer infants and children.", "executive_summary", "regular", "childcare.pdf"),
    ("Stigma in patients aged over 60", "Patients aged 60 with stroke: oral treatment, outpatient follow-up.", "general_clinical", "regular", "neuro.pdf"),
]

QUERIES = [
    "severe malaria artesunate dose", "uncomplicated malaria oral treatment", "meningitis treatment in adult",
    "pneumonia amoxicillin children under 5", "ds-TB first line regimen", "postpartum haemorrhage oxytocin",
    "neonatal sepsis antibiotic dose", "septic shock norepinephrine infusion", "dengue fluid management",
    "cholera ORS treatment", "burns parkland fluid", "rabies post-exposure prophylaxis vaccine",
    "snakebite antivenom dose", "sickle cell acute chest syndrome treatment", "dysentery first-line treatment",
    "typhoid fever treatment pregnant woman", "severe acute malnutrition RUTF management", "eclampsia MgSO4 dose woman",
    "hypertension emergency labetalol", "heart failure furosemide", "anemia transfusion criteria",
    "depression fluoxetine dosage", "appendicitis referral", "cardiac arrest adult adrenaline",
    "stroke management adult", "buruli ulcer rifampicin", "noma prevention", "asthma signs in child",
    "traumatic brain injury airway", "HIV antiretroviral when to refer", "how to treat fever", "simple advice",
    "scorpion sting treatment", "mild pneumonia outpatient", "ectopic pregnancy diagnosis", "psychosis haloperidol dose",
    "podoconiosis prevention", "schistosomiasis praziquantel dose child", "anaphylaxis adrenaline IM dose",
    "neonate jaundice phototherapy",
]

# turn texts: what an assistant turn starts with, by turn number modulo the list
ASSISTANT = [
    "<think>first thoughts</think><KB_QUERY>severe malaria dose</KB_QUERY>",
    "<think>more</think><kb_query> Sepsis fluids </kb_query> and <KB_QUERY>Severe Malaria Dose</KB_QUERY>",
    "DECISION: continue\n<KB_QUERY>sepsis fluids</KB_QUERY>\nNEXT_QUERY: none",
    "<think>done</think>\n## Alert Level\nYellow\n## Clinical Assessment\nStable.\n## clinical assessment\nAgain.\n## Safety Alert\n\n## Key Points\n",
]

# extraction lines by observation number modulo the list: label, value
OBSERVATIONS = [
    ("weight_kg", "63.2 kg"), ("_temperature_c", "38.5C"), ("kg", "30"), ("[test] cd4_count", "350"),
    ("systolic_blood_pressure", "120/80"), ("pulse", "present"), ("cough", "present"), ("malaria", "not present"),
    ("height_cm", "175cm"), ("diastolic_blood_pressure", '80h", "patient_id": "x"'), ("respiratory_rate", "5-10"),
    ("rash", "absent"), ("serum_glucose", "n/a"), ("fasting_blood_glucose_measurement_mg_dl", "99,"),
    ("weight_kg", "70"), ("free text label", "some value"),
]
