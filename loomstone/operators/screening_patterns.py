"""Fixed values of the screening classifier: patterns (any case unless a part says otherwise), sets of publication types and names of the questions."""

from __future__ import annotations

# Results depend on every one of them.
PERIOPERATIVE, KIDNEY, PREGNANCY, LIVER, ANTICOAGULATION = "HRS1_PERIOPERATIVE", "HRS2_KIDNEY_DISEASE", "HRS3_PREGNANCY", "HRS4_LIVER_DISEASE", "HRS5_ANTICOAGULATION"
QUESTIONS = (PERIOPERATIVE, KIDNEY, PREGNANCY, LIVER, ANTICOAGULATION)
REASON_CODES = ("population", "exposure", "outcome", "human_signal", "design_signal", "animal_term_present", "off_topic", "insufficient_abstract")
#: An abstract of so many characters is detailed enough to decide on.
DETAILED = 180
STRONG_EXPOSURE = (
    r"\b(?:dietary|food|nutrition(?:al)?|micronutrient|vitamin|mineral|herbal|herb|botanical|plant[- ]based) supplements?\b|\bsupplement(?:ation|ed|ing|s)?\b|"
    r"\b(?:herbal medicines?|herbal remedies|herbal products?|plant extracts?|plant preparations?|botanical products?|phytotherap\w*|phytomedicin\w*|"
    r"nutraceut\w*|natural health products?|multivitamins?|multiminerals?|oral nutritional supplements?|ONS)\b|"
    r"\b(?:fish oils?|omega[- ]?3(?: fatty acids?)?|docosahexaenoic acid|eicosapentaenoic acid|(?-i:DHA|EPA)|probiotics?|prebiotics?|synbiotics?|"
    r"coenzyme Q10|CoQ10|ubiquinone|ubidecarenone|glucosamine|chondroitin|ginkgo(?: biloba)?|ginseng|panax(?: ginseng| quinquefolius)?|garlic|"
    r"allium sativum|curcumin|turmeric|ginger|zingiber officinale|hypericum|st\.? john'?s wort|saint john'?s wort|kava|valerian|echinacea|ephedra|"
    r"ma huang|saw palmetto|serenoa repens|ashwagandha|cranberry|vaccinium macrocarpon|milk thistle|silymarin|licorice|liquorice|"
    r"glycyrrhiza|astragalus|aristoloch\w*|black cohosh|blue cohosh|evening primrose|raspberry leaf|kratom|garcinia|red yeast rice|usnic acid|"
    r"feverfew|dong quai|angelica sinensis|danshen|salvia miltiorrhiza|red clover|grape seed|resveratrol|quercetin|bromelain|chamomile|"
    r"cinnamon|hawthorn(?: fruit)?|nattokinase|natto|citrus aurantium|moringa oleifera|green tea extracts?|s[- ]?adenosylmethionine|(?-i:SAMe)|"
    r"herbalife|hydroxycut|oxyelite|lipokinetix|centrum|elevit|pregnacare|pregvit|tebonin|kyolic|ginsana|pycnogenol|sensoril|ksm[- ]?66|"
    r"metamucil|omacor|lovaza|tinospora(?: cordifolia| crispa)?|gynura(?: segetum)?|polygonum multiflorum|jujube|ziziphus jujuba)\b"
)
TRADITIONAL_EXPOSURE = (
    r"\b(?:traditional Chinese (?:herbal )?medicine|Chinese (?:herbal|patent) medicines?|Chinese medicine|TCM (?:formula|formulation|decoction|medicine|treatment|regimen)|"
    r"Kampo medicine|myo[- ]?inositol|inositol|glycyrrhizin preparations?)\b|\b(?:herbal|botanical|traditional medicine) (?:medications?|formula(?:tion)?|capsules?|"
    r"preparations?|treatment|therapy|use|usage)\b|\b(?:modified )?[A-Za-z]+ decoction\b|\b[A-Za-z][A-Za-z'-]+(?:\s+[A-Za-z][A-Za-z'-]+){1,4}\s+(?:Tang|Wan|San)\b"
)
SUPPLEMENT_FORM = (
    r"\b(?:dietary|food|nutrition(?:al)?|micronutrient|vitamin|mineral|herbal|herb|botanical|plant[- ]based|oral nutritional) supplements?\b|"
    r"\bsupplement(?:ation|ed|ing|s)?\b|\b(?:capsules?|tablets?|extracts?|formulations?|over[- ]the[- ]counter|nonprescription|non-prescription)\b"
)
NUTRIENT = (
    r"\b(?:vitamins?\s*[A-EK]?|vitamin\s+B(?:1|2|3|5|6|7|9|12)|folic acid|folate|methylfolate|folinic acid|iron|ferrous\w*|calcium|magnesium|"
    r"potassium|zinc|selenium|iodine|iodide|retinol|beta[- ]carotene|cyanocobalamin|cobalamin|pyridoxine|ascorbic acid|choline|inositol|"
    r"tocopherol|phylloquinone|menaquinone)\b"
)
ADMINISTRATION = (
    r"\b(?:supplement(?:ation|ed|ing)?|administer(?:ed|ing)?|administration|received|given|taking|took|treated with|therapy|intervention|exposure|use of|users? of|"
    r"consum(?:ed|ption)|intake|dose[ds]?|dosing|capsules?|tablets?|oral(?:ly)?|over[- ]the[- ]counter|OTC)\b"
)
RELATION = (
    r"\b(?:administer(?:ed|ing|ation)?|received|given|taking|took|treated with|supplement(?:ation|ed|ing)?|consum(?:ed|ption)|intake|dose[ds]?|dosing|"
    r"capsules?|tablets?|oral(?:ly)?|use|usage|users?|caused|induced|attributed|associated|adverse|injury|toxicity|regimen|intervention)\b"
)
#: Characters around a nutrient or an exposure in which its context must stand, and between two concepts that belong together.
NUTRIENT_REACH, EXPOSURE_REACH, PROCEDURE_REACH = 90, 130, 220
NOT_A_SUPPLEMENT = (
    r"\b(?:progesterone|oxygen|fluid|saline|infant formula|milk|hormone|enzyme|dexmedetomidine|propofol|parenteral nutrition|antithrombin|"
    r"fresh frozen plasma|FFP|blood product) supplement\w*\b|\bsupplement\w*\s+(?:with\s+|of\s+)?(?:antithrombin|fresh frozen plasma|FFP|blood products?)\b"
)
NOT_THERAPEUTIC = (
    r"\bsupplement(?:ing|ed)?\s+(?:instruction|instructions|information|education|training|teaching|curriculum|feedback|explanation|materials?)\b|"
    r"\bsupplementary (?:data|material|materials|appendix|information)\b"
)
INSTITUTION = (
    r"\b(?:hospital|department|school|college|university|academy|institute|ward|center|centre|clinic)\b[^.;]{0,90}\b(?:traditional Chinese medicine|TCM)\b|"
    r"\b(?:traditional Chinese medicine|TCM)\b[^.;]{0,90}\b(?:hospital|department|school|college|university|academy|institute|ward|center|centre|clinic)\b"
)
VITAMIN_K_MECHANISM = r"\b(?:vitamin K antagonists?|vitamin K[- ]dependent|VKORC?1?|vitamin K epoxide|vitamin K recycling|mechanism of warfarin)\b"
VITAMIN_K_NOISE = (
    r"\b(?:non[- ]vitamin[- ]?K(?:[- ]dependent)?|vitamin[- ]?K[- ]?antagonists?|vitamin K antagonists?|antagonists? of vitamin K|vitamin K[- ]dependent|"
    r"vitamin K epoxide|vitamin K recycling|VKORC?1?)\b"
)
VITAMIN_K_THERAPY = (
    r"\b(?:vitamin K1?|phytonadione)\b[^.;]{0,140}\b(?:administered|given|treated|therapy|management|reversal|antidote|coagulopathy|overdose|poisoning|rodenticide)\b|"
    r"\b(?:reversal|antidote|coagulopathy|overdose|poisoning|rodenticide)\b[^.;]{0,140}\b(?:vitamin K1?|phytonadione)\b"
)
VITAMIN_K_REVERSAL = (
    r"\b(?:phytonadione|vitamin K)\b.{0,100}\b(?:reversal|reverse|antidote|coagulopathy|overdose|poisoning)\b|\b(?:reversal|antidote|coagulopathy|"
    r"overdose|poisoning)\b.{0,100}\b(?:phytonadione|vitamin K)\b"
)
NUTRITION_TITLE = r"\b(?:micronutrition|nutritional intervention)\b"
PREVENTION_TITLE = r"\b(?:prevent|prevention of|reduce(?:s|d)? (?:the )?risk of)\b"
PREGNANCY_TRIAL_TITLE = r"\b(?:trial|supplement(?:ation)?|antenatal|prenatal vitamin|prenatal mineral)\b"
ORDINARY_DIET = (
    r"\b(?:diet(?:ary)? quality|dietary diversity|dietary patterns?|food patterns?|food consumption|food frequency|24\s*(?:h|hour)[- ]recall|dietary recalls?|ordinary diet|"
    r"whole grains?|fruit and vegetable|vegetables?|food intake|nutrient intake|nutrient content|iodine nutrition|phosphate intake|phosphorus intake|"
    r"vegetarian|plant[- ]based diet|dietary fatty acids?|dietary (?!supplement)[^.]{0,60} intake)\b"
)
DIETARY_INTAKE = r"\bdietary intake\b"
MEAL_PROGRAM = r"\b(?:community meals?|meal supplementation|food program|feeding program)\b"
NAMED_SUPPLEMENTATION = r"\b(?:dietary fiber|potassium|vitamin|mineral|micronutrient|protein|oral nutritional) supplementation\b"
NOT_ORAL = (
    r"\b(?:intravenous|intramuscular|subcutaneous|parenteral|infusion|injection|topical|transdermal|eye ?drops?|ophthalmic|ointment|cream|gel|mouthwash|"
    r"local application|implant|intra[- ]?socket)\b"
)
ORAL = r"\b(?:oral(?:ly)?|by mouth|capsules?|tablets?|drink|decoction)\b"
AROMATHERAPY = r"\baromatherapy\b"
BIOMARKER_TITLE = (
    r"\b(?:serum|plasma|blood|circulating|urinary|fecal|faecal|tissue)\b.*\b(?:level|status|concentration|deficien\w*|metabolism|homeostasis|biomarker)|"
    r"\b(?:vitamin|mineral|magnesium|calcium|iron|folate|zinc|selenium)\w* status\b"
)
ENDOGENOUS_NUTRIENT = (
    r"\b(?:hypomagnesemia|hypermagnesemia|circulatory imbalance|trace element levels?|nutrient status|vitamin status|mineral status|serum (?:magnesium|calcium|iron|"
    r"zinc|selenium|vitamin)|plasma (?:magnesium|calcium|iron|zinc|selenium|vitamin))\b"
)
MEASURED_NUTRIENT = r"\b(?:serum|plasma|blood|urinary|urine|fecal|faecal)\b[^.;]{0,45}\b(?:vitamin|mineral|iron|folate|iodine|choline|calcium|magnesium|zinc|selenium)\b"
NUTRIENT_MEASURE = r"\b(?:vitamin|mineral|iron|folate|iodine|choline|calcium|magnesium|zinc|selenium)[^.;]{0,45}\b(?:status|levels?|concentrations?|deficien\w*|metabolism|predictors?)\b"
INTERVENTION_TITLE = r"\b(?:randomi[sz]ed|controlled trial|efficacy and safety|administered|received|given)\b"
INTERVENTION_NUTRIENT = r"\b(?:ferrous|folinic acid|vitamin|mineral|calcium|iron|folate|iodine|choline|zinc|selenium)\b"
MALNUTRITION = r"\b(?:malnutrition|undernutrition|nutritional status)\b"
ALTERNATIVE_TITLE = (
    r"\b(?:aromatherapy|hypnosis|acupuncture|electroacupuncture|acupressure|moxibustion|massage|music therapy|sun exposure|self[- ]testing|"
    r"point[- ]of[- ]care testing|medical device|diagnostic (?:test|efficacy|utility)|screening|assay|reference interval|reticulocyte hemoglobin|hemoglobin trend|"
    r"elastography|radial pulse|microbiome|genetic testing|prenatal testing|community meals?|meal supplementation|ordinary diet|diet quality|"
    r"knowledge[- ]transfer|curriculum|training|education|course|coffee|caffeine|breathing exercises?|physical therapy|electrical stimulation|transcutaneous electrical)\b"
)
NAMED_TARGET = r"\b(?:probiotics?|prebiotics?|synbiotics?|herbal medicines?|plant extracts?)\b"
HARD_ALTERNATIVE = (
    r"\b(?:genetic testing|prenatal testing|screening|assay|reference interval|reticulocyte hemoglobin|hemoglobin trend|sun exposure|knowledge[- ]transfer|"
    r"curriculum|education|course|coffee|caffeine|breathing exercise|electrical stimulation|acupressure|moxibustion|massage|music therapy|aromatherapy|hypnosis)\b"
)
OTHER_FOCUS = (
    r"\b(?:bibliometric|curriculum|education|training|course|knowledge[- ]transfer|practice patterns?|current practices?|views and experiences|providers?|"
    r"physicians?|pharmacists?|surgeons?|candidate (?:drug|medicine|herb)|Mendelian randomization|syndrome classification|tongue imag(?:e|es|ing)|"
    r"diagnostic imag(?:e|es|ing)|prediction model|risk model|food composition|nutrient content|levels? in (?:foods?|vegetables?|serum|plasma|urine|feces|faeces))\b"
)
GIVEN_TITLE = r"\b(?:supplement(?:ation|ed|ing)?|received|given|taking|treated with|use of)\b"
SUMMARY_TITLE = r"\b(?:evidence summary|clinical practice guideline|pain management)\b"
CHINESE_MEDICINE = r"\b(?:traditional Chinese medicine|TCM)\b"
NAMED_PRODUCT = r"\b(?:herbal|botanical|decoction|formula(?:tion)?|capsule|tablet|extract|supplement(?:ation)?|patients? received|treated with)\b"
KIDNEY_DRUG = (
    r"\b(?:sodium thiosulfate|cinacalcet|etelcalcetide|paricalcitol|doxercalciferol|maxacalcitol|alfacalcidol|ferumoxytol|sodium zirconium cyclosilicate|patiromer|"
    r"sevelamer|lanthanum carbonate|sucroferric oxyhydroxide|ferric citrate|denosumab|bisphosphonate|zoledronate|anti[- ]?tuberculous|phosphate binders?|"
    r"HIF[- ]?PHI|hypoxia[- ]inducible factor prolyl hydroxylase inhibitors?|citrate anticoagulation)\b"
)
PREGNANCY_OTHER_FOCUS = r"\b(?:seizure control|antiseizure medication|valproate|progesterone|regulatory compliance|health claims?|product labels?)\b"
MICROBIOME = r"\bmicrobiome\b"
VITAMIN_K_DRUG_TITLE = r"\b(?:non[- ]vitamin[- ]?K|vitamin[- ]?K antagonists?)\b"
VITAMIN_K_FOOD = r"\b(?:supplement(?:ation)?|dietary vitamin K)\b"
MEASURED_VITAMIN_K = r"\b(?:serum|plasma|blood|fecal|faecal)\b[^.;]{0,100}\bvitamin K|\bvitamin K\b[^.;]{0,100}\b(?:serum|plasma|blood|fecal|faecal|microbiota|levels?|concentrations?)\b"
BLOOD_PRODUCT = (
    r"\b(?:antithrombin|fresh frozen plasma|FFP|PCC|prothrombin complex)\b[^.;]{0,80}\bsupplement\w*\b|\bsupplement\w*\b[^.;]{0,80}"
    r"\b(?:antithrombin|fresh frozen plasma|FFP|PCC|prothrombin complex)\b"
)
ANTITHROMBIN_TITLE, ANTITHROMBIN_SHORT = r"\bantithrombin supplementation\b", r"(?-i:\bAT supplementation\b)"
DRUG_COMPARISON = (
    r"\b(?:versus|vs\.?|compared with|comparison of)\b.*\b(?:warfarin|apixaban|rivaroxaban|edoxaban|dabigatran|heparin|enoxaparin|anticoagulan\w*|DOACs?|NOACs?|VKAs?)\b|"
    r"\b(?:warfarin|apixaban|rivaroxaban|edoxaban|dabigatran|heparin|enoxaparin|DOACs?|NOACs?|VKAs?)\b.*\b(?:versus|vs\.?|compared with)\b"
)
COMPARED_SUPPLEMENT = r"\b(?:dietary supplements?|herbal|botanical|probiotic|prebiotic|vitamin K supplement|Chinese patent medicine|natural product)\b"
LUPUS = r"\blupus anticoagulants?\b"
HEPARIN_MATERIAL = r"\b(?:recombinant heparin|heparin production|heparin[- ](?:poloxamer|coated|conjugate|binding|mimetic|hydrogel|nanogel|scaffold|sepharose|sulfate))\b"
POPULATION = {
    PERIOPERATIVE: (
        r"\bsurger\w*|\bsurgical\b|\boperati(?:on|ve)\w*|peri.?oper|pre.?oper|post.?oper|\banesth|\banaesth|endoscop|biops|catheteri[sz]|cesarean|"
        r"caesarean|operating room|invasive procedure|transplant(?:ation)?|radiofrequency ablation|cryoablation|internal fixation|external fixation"
    ),
    KIDNEY: r"kidney|renal|dialys|dialyz|hemodial|haemodial|peritoneal dialysis|\bckd\b|\besrd\b|\beskd\b|uremi|uraemi|nephropath|kidney failure|renal failure",
    PREGNANCY: r"pregnan|gestation|maternal|antenatal|prenatal|perinatal|fetal|foetal|fetus|foetus|in utero|intra.?uterine|obstetric|trimester|gravida",
    LIVER: (
        r"\bliver\b|hepatic|hepatit|cirrho|steato|fatty liver|\bnafld\b|\bnash\b|\bmasld\b|\bmash\b|cholang|portal hypertension|wilson disease|"
        r"hemochrom|haemochrom|hepatotox|drug.induced liver|herb.induced liver|\bdili\b|\bhili\b"
    ),
    ANTICOAGULATION: (
        r"warfarin|coumadin|jantoven|acenocoumarol|nicoumalone|phenprocoumon|fluindione|phenindione|dicou?marol|apixaban|rivaroxaban|edoxaban|dabigatran|"
        r"betrixaban|ximelagatran|heparin|enoxaparin|dalteparin|tinzaparin|nadroparin|bemiparin|certoparin|\bdoacs?\b|\bnoacs?\b|\bvkas?\b|\blmwh\b|\bufh\b|"
        r"factor xa inhibitor|direct thrombin inhibitor|oral anticoagulan|vitamin[- ]?K antagonist therapy|vitamin K antagonist therapy|"
        r"anticoagulat(?:ed|ion therapy|ion treatment)|receiv(?:e|ed|ing) anticoagulan|anticoagulant (?:use|users?|therapy|treatment)"
    ),
}
OUTCOME = {
    PERIOPERATIVE: (
        r"bleed|hemorr|haemorr|transfus|coag|interaction|anesth.*effect|anaesth.*effect|perioperative complication|postoperative complication|surgical complication|"
        r"micronutrient deficien|vitamin deficien|mineral deficien|anemi|anaemi|osteoporosis|cardiomyopathy|non[- ]?adherence|hypocalcemi|readmission|"
        r"ischemic colitis|ischaemic colitis|phlebosclerotic colitis|colorectal mucosal injur"
    ),
    KIDNEY: (
        r"hyperkal|hypercal|electrolyte|nephrotox|kidney injur|renal injur|cardiovascular|arrhythm|calcification|oxalat|accumulat|uremic symptom|uraemic symptom|"
        r"catheter occlu|occlud\w*.{0,30}catheter"
    ),
    PREGNANCY: (
        r"\bcongenital|\bterat(?:ogen|ogenic|ogenicity|ology)\w*|\bmalformation|\banomal(?:y|ies|ous)|\bmiscar|\babortion|\bstillbirth|\bpreterm|"
        r"\bprematur(?:e birth|ity)|birth defect|low birth weight|growth restriction|maternal complication|neonatal complication|fetal complication|foetal complication|"
        r"preeclamps|eclamps|calcium[- ]alkali syndrome|acute pancreatitis|bacteremia|sepsis|childhood wheez|offspring wheez|childhood asthma|offspring asthma|atopic dermatitis"
    ),
    LIVER: (
        r"hepatotox|liver injur|hepatic injur|liver failure|hepatic failure|decompens|acute hepatitis|"
        r"(?:elevat|increas|worsen|abnormal).{0,40}(?:aminotransferase|\balt\b|\bast\b|bilirubin)|jaundice|transplant|\bdili\b|\bhili\b"
    ),
    ANTICOAGULATION: (
        r"bleed|hemorr|haemorr|thrombo|embol|\binr\b|\bcoagulation (?:test|tests|parameter|parameters|profile|change|changes|abnormalit\w*)|"
        r"prothrombin|\bpt\b|\baptt\b|interaction|pharmacokinetic|cyp2c9|cyp3a4|p.glycoprotein|p.?gp"
    ),
}
MONOGRAPH = r"^\s*CLINICAL CHARACTERISTICS\s*:"
NOT_SURGICAL = r"\bnon[- ]surgical\b"
TEACHING_TITLE = r"\b(?:students?|training|teaching|curriculum|role[- ]play)\b"
PROCEDURE = (
    r"\b(?:patients?|participants?|subjects?)\b[^.;]{0,120}\b(?:underwent|undergoing|scheduled for|after|before|following)\b[^.;]{0,90}\b(?:surgery|operation|operative procedure|"
    r"invasive procedure|ablation|transplantation)\b|\b(?:underwent|undergoing|scheduled for|after|before|following)\b[^.;]{0,90}\b(?:surgery|operation|operative procedure|"
    r"invasive procedure|ablation|transplantation)\b"
)
AROUND_OPERATION = r"\b(?:perioperative|postoperative|preoperative)\b"
SURGICAL_PROVIDER, SURGICAL_PRACTICE = r"\b(?:surgeons?|physicians?|clinicians?|providers?|residents?|trainees?)\b", r"\b(?:practice|survey|views?|experiences?|training|assessment|evaluation)\b"
CONSEQUENT_PROCEDURE = (
    r"\b(?:liver failure|injury|toxicity|poisoning)\b[^.;]{0,80}\b(?:requiring|leading to|resulting in)\b[^.;]{0,60}\b(?:transplant|surgery|operation|endoscopy|transplantation)\b"
)
PROCEDURE_SUPPLEMENT = r"\b(?:supplement(?:ation|ed|ing)?|herbal|botanical|decoction|vitamin|calcium|iron|probiotic|prebiotic|synbiotic|fish oil|omega[- ]?3)\b"
PEDIATRIC, ADULT = r"\b(?:pediatric|paediatric|children|child|infant|adolescent|neonat\w*|newborn)\b", r"\b(?:adults?|elderly|aged|men|women)\b"
NO_KIDNEY_DISEASE = r"\b(?:non[- ]CKD|without (?:chronic )?kidney disease)\b"
KIDNEY_PATIENTS = (
    r"\b(?:chronic kidney disease|kidney failure|renal failure|end[- ]stage (?:kidney|renal) disease|(?:hemo|haemo|peritoneal )?dialysis (?:patients?|population)|"
    r"patients? (?:with|undergoing) (?:CKD|chronic kidney|renal|dialysis)|CKD patients?)\b"
)
KIDNEY_STAFF, STAFF_WORK = r"\b(?:dietitians?|nurses?|physicians?|providers?|staff)\b", r"\b(?:survey|practice|work|views?|experiences?|dilemmas?|policy)\b"
GENETIC_TESTING = r"\b(?:prenatal|preimplantation)(?: and (?:prenatal|preimplantation))? genetic testing\b|\bprenatal diagnosis\b|\bprenatal testing\b[^.]*"
PREGNANCY_TIME = (
    r"\b(?:pregnan(?:cy|cies|t)|antenatal(?:ly)?|prenatal(?:ly)?|perinatal|maternal|pre[- ]?conception(?:al|ally)?|(?:first|second|third) trimester)\b|"
    r"\bgestational\b(?!\s+age\b)|\bduring (?:early |late |the )?(?:pregnancy|gestation)\b"
)
GESTATION_TITLE = r"\b(?:pregnan(?:cy|cies|t)|antenatal|prenatal|perinatal|gestational|trimester|during (?:the )?pregnancy)\b"
PREGNANT_PEOPLE = r"\b(?:pregnant (?:women|patients?|participants?)|women (?:who were )?pregnant|maternal (?:supplementation|exposure|intake|use|outcomes?)|participants? during pregnancy)\b"
REVIEW_TITLE = r"\b(?:review|meta-analysis)\b"
ECLAMPSIA = r"\b(?:pre[- ]?eclampsia|eclampsia)\b"
POSTPARTUM = r"\b(?:post[- ]?partum|postnatal|lactation|lactating|breastfeeding|nursing mothers?)\b"
NEONATAL = r"\b(?:neonat|newborn|preterm infant|premature infant|NICU|necrotizing enterocolitis|necrotising enterocolitis)\w*\b"
BABIES = r"\bbabies\b"
REGULATION_TITLE = r"\b(?:regulatory compliance|health claims?|product labels?|supplement use statistics)\b"
NO_LIVER_DISEASE = r"\b(?:without|no|absence of|free of)\b[^.;]{0,60}\b(?:liver|hepatic) (?:disease|dysfunction|injury|failure)\b"
LIVER_EXISTING = (
    r"\b(?:pre[- ]?existing|underlying|chronic|advanced|end[- ]stage|decompensated) (?:liver|hepatic) diseases?|\bliver (?:disease|cirrhosis|fibrosis|cancer)|"
    r"\bhepatic (?:disease|fibrosis|steatosis)|\bcirrho(?:sis|tic)|\bchronic hepatitis|\bhepatitis [BC]\b|\bHBV\b|\bHCV\b|"
    r"\b(?:alcoholic|alcohol[- ]related|alcohol[- ]associated) liver disease|\bNAFLD\b|\bNASH\b|\bMASLD\b|\bMASH\b|\bMAFLD\b|\bautoimmune hepatitis|"
    r"\bprimary (?:biliary|sclerosing) cholangitis|\bPBC\b|\bPSC\b|\bportal hypertension|\bWilson'?s? disease|\bh(?:ae|e)mochromatosis|\bhepatocellular carcinoma"
)
ENCEPHALOPATHY = r"\bhepatic encephalopathy\b"
LIVER_PATIENTS = (
    r"\b(?:patients?|participants?|subjects?)\b[^.;]{0,180}\b(?:liver|hepatic|cirrho|hepatitis|NAFLD|NASH|MASLD|MASH|PBC|PSC)\b|"
    r"\b(?:liver|hepatic|cirrho|hepatitis|NAFLD|NASH|MASLD|MASH|PBC|PSC)\b[^.;]{0,180}\b(?:patients?|participants?|subjects?)\b"
)
LIVER_REVIEW_TITLE = r"\b(?:systematic review|meta-analysis|guideline|review)\b"
LIVER_INJURY = r"\b(?:hepatotox\w*|(?:drug|herb|supplement)[- ]induced liver injury|DILI|HILI|(?:acute )?(?:liver|hepatic) injur\w*|(?:liver|hepatic) failure|acute hepatitis|jaundice)\b"
CAUSED = r"\b(?:caused by|induced by|associated with|secondary to|attributed to|due to)\b"
HERB_CAUSED_INJURY = r"\b(?:herbal|dietary|supplement|botanical).{0,80}(?:induced|related|can cause|caused).{0,50}(?:liver|hepatic) injur"
CAUSED_TITLE = r"\b(?:associated|induced|secondary|attributed|caused|due)\b"
PROTECTIVE = r"\b(?:prevent\w*|protect\w*|ameliorat\w*|attenuat\w*|alleviat\w*|treat\w*|manage\w*|reduc\w*|improv\w*)\b"
CAUSED_BY_HERB_TITLE = r"\b(?:caused by|attributed to|secondary to|associated with)\b[^.;]{0,80}\b(?:supplement|herb|botanical|extract)\b"
HEALTHY = r"\bhealthy (?:human )?(?:volunteers?|participants?|subjects?)\b"
LIVER_GENE_TITLE = r"\b(?:autosomal recessive polycystic kidney disease|PKHD1|Caroli disease)\b"
ON_ANTICOAGULANT = (
    r"\b(?:patients?|participants?|subjects?|individuals?|users?)\b[^.;]{0,160}\b(?:taking|receiving|treated with|using|on)\b[^.;]{0,80}"
    r"\b(?:warfarin|coumadin|acenocoumarol|phenprocoumon|apixaban|rivaroxaban|edoxaban|dabigatran|heparin|enoxaparin|anticoagulan\w*)\b|"
    r"\b(?:warfarin|coumadin|acenocoumarol|phenprocoumon|apixaban|rivaroxaban|edoxaban|dabigatran|heparin|enoxaparin|anticoagulan\w*)"
    r"\b[^.;]{0,100}\b(?:patients?|participants?|subjects?|individuals?|users?)\b"
)
BROAD_REVIEW_TITLE = r"\b(?:review|guideline|consensus|statement|chapter)\b"
DRUG_PROVIDER, DRUG_PRACTICE = r"\b(?:physicians?|pharmacists?|clinicians?|providers?|staff)\b", r"\b(?:views?|experiences?|survey|practice|knowledge|attitudes?)\b"
THROMBOSIS_TITLE = r"\b(?:registry|recurrent venous thromboembolism|thrombosis risk)\b"
DIRECT_SAFETY = (
    r"\b(?:safety|safe|tolerab\w*|adverse (?:events?|effects?|outcomes?|reactions?)|no adverse events?|toxicit\w*|hepatotox\w*|bleed\w*|hemorrh\w*|haemorrh\w*|"
    r"transfus\w*|poison\w*|overdose|contraindicat\w*|drug interactions?|supplement interactions?|hospitali[sz]\w*|withdraw\w*|"
    r"treatment errors?|complication rates?|serious events?|potential risk)\b"
)
GENERIC_OUTCOME = (
    r"\b(?:safety|safe|well[- ]tolerated|adverse(?: events?| effects?| outcomes?| reactions?)?|toxic(?:ity|ities)?|side effects?|harms?|harmful|complications?|mortality|deaths?|"
    r"hospitali[sz](?:ation|ed|ations)?|emergency department|discontinu\w*|withdrawal|intoler\w*|overdose|poison\w*|contraindicat\w*|interactions?|"
    r"laboratory abnormal\w*|serious events?)\b"
)
SAFETY_EVALUATION = (
    r"\b(?:adverse events? (?:were|was) (?:monitored|recorded|assessed)|(?:safety|tolerability) (?:was|were|is) (?:assessed|evaluated|comparable)|"
    r"incidence of adverse (?:events?|reactions?)|no (?:reported )?(?:adverse events?|safety concerns?)|(?:lower|higher|reduced|increased) complication rates?|"
    r"(?:caused|induced|attributed to|associated with|secondary to).{0,80}(?:injury|failure|toxicity|syndrome|bleeding|hemorrhage|haemorrhage)|"
    r"safety considerations|risk of (?:toxicity|bleeding|hemorrhage|haemorrhage|adverse|benzene exposure|hyperkal\w*|calcification))\b"
)
AFTER_OPERATION = r"\b(?:postoperative blood pressure|postoperative atrial fibrillation|postoperative infection|surgical site infection|wound complication)\b"
BLOOD_PRESSURE = r"\bblood pressure\b"
HERB_INJURY = r"\b(?:herbal|dietary|supplement|botanical|extract).{0,50}(?:induced|related|associated|toxicity|injury)\b"
SYSTEMATIC_TITLE, SAFETY_TITLE = r"\b(?:systematic review|meta-analysis)\b", r"\bsafety\b"
LIVER_MONOGRAPH_TITLE = r"\b(?:polycystic kidney disease|PKHD1|Caroli disease)\b"
EFFICACY_ENDPOINT = (
    r"\b(?:efficacy|effectiveness|effects? of|therapeutic (?:effect|potential)|curative effect|treatment effect|management of|improv\w*|ameliorat\w*|attenuat\w*|regulat\w*|"
    r"protective effect|prevention of|activity|activities|inflammatory (?:markers?|factors?)|oxidative stress|immune cells?|myeloid|T lymphocytes?|sustained attention|cognition|"
    r"proteinuria|albuminuria|liver enzyme activity|physiological alterations|biomarkers?|serum levels?|plasma levels?|pulse waveforms?|symptom burden|"
    r"wellbeing|appetite|tiredness|bone mass)\b"
)
EFFICACY_ONLY = (
    r"\b(?:efficacy|effectiveness|benefit|improv(?:e|ed|ement)|ameliorat\w*|protective effect|treatment effect|treatment of|treating|prevention|adherence|quality of life|"
    r"symptom score|performance|recovery|length of stay|nutritional status|weight loss|postoperative sleep|sleep quality|sleep disturbance|inflammatory (?:factors?|markers?)|"
    r"metabolic effects?|immune cells?|myeloid|T lymphocytes?)\b"
)
OPERATION_EFFICACY_TITLE = r"\b(?:efficacy|effectiveness|clinical outcomes?|quality of life|symptom scores?|LUTS|erectile function|functional recovery|bowel recovery|rehabilitation)\b"
STATED_AIM = r"\b(?:objective|aim|purpose)\b[^.;]{0,180}\b(?:efficacy|effectiveness|symptom|recovery|quality of life)\b"
OPERATION_EFFICACY = r"\b(?:efficacy|effectiveness|LUTS|erectile function|quality of life|functional recovery|bowel recovery)\b"
#: Characters of the foreground in which an aim and an efficacy measure are looked for.
AIM_WITHIN, EFFICACY_WITHIN = 900, 1200
FEASIBILITY = r"\bfeasibility\b"
REVIEW_EFFICACY_TITLE = r"\b(?:efficacy|effectiveness|quality of life|symptom|recovery)\b"
LIVER_EFFICACY_TITLE = (
    r"\b(?:efficacy|effectiveness|mechanism|regulat\w*|ameliorat\w*|protect\w*|prevent\w*|therapeutic|treatment of|management of|multi[- ]target signaling|anti[- ]fibrotic)\b"
)
LIVER_SAFETY_TITLE = r"\b(?:safety|tolerab\w*|adverse events?|toxicity (?:of|associated with)|supplement[- ]induced|herb[- ]induced)\b"
EFFICACY_TITLE = (
    r"\b(?:efficacy|effectiveness|clinical effect|therapeutic effect|mechanism of action|protect(?:s|ed|ive)? against|ameliorat\w*|attenuat\w*|"
    r"improv\w*|reduc(?:e|ed|es|ing) (?:the )?risk|management of|treatment of|prevention of|prevent\w*|recovery|quality of life|anthropometric|"
    r"symptom scores?|adherence|coverage|utilization|service use)\b"
)
HARM_TITLE = (
    r"\b(?:safety|tolerab\w*|adverse|toxicit\w*|harm|complication|bleed\w*|hemorrh\w*|haemorrh\w*|hospitali[sz]\w*|readmission|discontinu\w*|"
    r"mortality|death|injury caused by|induced liver injury)\b"
)
HUMAN_STUDY = (
    r"\b(?:we (?:enrolled|recruited|randomi[sz]ed|followed|reviewed)|(?:patients?|participants?|subjects?|pregnant women|adults?|children) (?:were|who|with)|"
    r"(?:enrolled|recruited|included|randomi[sz]ed) \d+|\d+[ -](?:patients?|participants?|subjects?|women|men|adults?|children)|case report|case series|"
    r"clinical trial|prospective (?:study|cohort)|retrospective (?:study|cohort))\b"
)
HUMAN_TITLE = (
    r"\bpatients?\b|\bparticipants?\b|\bsubjects?\b|\bhumans?\b|\bclinical\b|\bcohort\b|\btrial\b|\bcase reports?\b|\bcase series\b|\bmen\b|\bwomen\b|"
    r"\badults?\b|\bchildren\b|\binfants?\b|pregnan\w*|maternal|persons?|people|volunteers?|hospital|outpatients?|inpatients?"
)
DESIGN = (
    r"randomi[sz]|trial|cohort|case.control|cross.section|registry|surveillance|pharmacovigilance|case report|case series|systematic review|meta.analysis|"
    r"retrospective|prospective|observational|guideline|review"
)
DESIGN_TYPES = (
    "clinical trial", "clinical trial protocol", "controlled clinical trial", "randomized controlled trial", "observational study", "comparative study", "case reports",
    "systematic review", "meta-analysis", "review", "guideline", "practice guideline", "multicenter study",
)
LIVER_DRUG_TITLE = (
    r"\b(?:anti[- ]?tuberculosis|antituberculosis|isoniazid|rifampin|rifampicin|pyrazinamide|ceftaroline|valproic acid|valproate|acetaminophen|paracetamol|"
    r"amoxicillin|clavulanate|methotrexate|statins?|chemotherapy|checkpoint inhibitor)\b"
)
DRUG_INJURY_TITLE, HERBAL_TEXT = r"\bdrug[- ]induced liver injury\b|\bDILI\b", r"\b(?:herbal|dietary supplements?|botanical|natural product)\b"
BROAD_INTERACTION = r"\b(?:diet|dietary|food|nutrition|herbal|botanical|supplement|complementary medicine|drug interactions?|lifestyle factors?)\b"
# End of fixed values.
