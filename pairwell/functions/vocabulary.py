"""Word lists, patterns and constants that results depend on."""

# German sheet headers (whitespace removed, lower case) and their English names.
MAIN_HEADERS = {
    "studien-id": "study_id",
    "audio-id": "audio_id",
    "geburtsjahr": "birth_year",
    "sex": "sex",
    "körpergröße(cm)": "height_cm",
    "gewicht(kg)": "weight_kg",
    "bmi": "bmi",
    "Ready_to_Use": "ready_to_use",
    "lungenerkrankung-haupt": "lung_disease_main",
    "lungenerkrankung2": "lung_disease_2",
    "lungenerkrankung3": "lung_disease_3",
    "lungenerkrankung4": "lung_disease_4",
    "controll": "control",
    "longitudinal": "longitudinal",
    "copd:exazerbiert?": "copd_exacerbated",
    "copdexazerbationschwer": "copd_exacerbation_severe",
    "copdexazerbationmittel": "copd_exacerbation_moderate",
    "copdexazerbationleicht": "copd_exacerbation_mild",
    "copd:goldi-iv?": "copd_gold_stage",
    "copd:gruppea/b/e?": "copd_group_a_b_e",
    "packyears": "pack_years",
}

# Disease terms and their standard names.
DISEASE_TERMS = {
    "asthma": "asthma",
    "keine bekannt": "control",
    "restriktion": "restriction",
    "copd": "copd",
    "lungenfibrose": "fibrosis",
    "ohs": "ohs",
    "ph": "ph",
    "cteph": "cteph",
    "sarkoidose": "sarcoidosis",
    "exogen-allergische alveolitis": "hypersensitivity_pneumonitis",
    "granulomatose mit polyangiitis": "granulomatosis_w_polyangiitis",
    "pneumonie influenza a": "influenza_a_pneumonia",
    "bronchiektasen": "bronchiectasis",
    "lungenemphysem": "emphysema",
    "z.n. mykoplasmeninfektion": "post_mycoplasma_infection",
    "lungen-ca": "lung_cancer",
}

# Disease columns, columns dropped after cleaning, numeric columns.
DISEASE_COLUMNS = ["lung_disease_main", "lung_disease_2", "lung_disease_3", "lung_disease_4"]
DROPPED_COLUMNS = ["copd_exacerbation_severe", "copd_exacerbation_moderate", "copd_exacerbation_mild"]
NUMERIC_COLUMNS = ["birth_year", "height_cm", "weight_kg", "longitudinal"]

# Texts that mean "missing", in raw sheets and in reloaded tables.
RAW_NULL_TOKENS = ["nicht vorhanden", "unbekannt", "nan", "/", "", " ", "null", "NULL", "NaN", "NAN"]
RELOAD_NULL_TOKENS = ["nan", "NaN", "NAN", "", " ", "null", "NULL"]

# Closed vocabularies of the recording table.
DISEASES = sorted(set(DISEASE_TERMS.values()))
CATEGORIES = ["a", "i", "o", "poem"]
LOCAL_SOURCE = "charite"
CROWD_SOURCE = "uk_covid"
SOURCES = [LOCAL_SOURCE, CROWD_SOURCE]

# Fixed value: header field of nested result files that names the cohort variant.
VARIANT_FIELD = "charite_cohort_variant"

# Audio file names of single and dated recordings.
SINGLE_FILE = r"^\d{1,4}_[A-Za-z]+\.wav$"
DATED_FILE = r"^\d{1,4}_[A-Za-z]+_\d{8}\.wav$"

# Age bands and sex shares of the target population.
FINE_EDGES = (55, 65, 75)
FINE_LABELS = ("<=55", "56-65", "66-75", ">75")
FINE_SHARES = (0.086, 0.275, 0.341, 0.298)
COARSE_EDGES = (65, 75)
COARSE_LABELS = ("<=65", "66-75", ">75")
COARSE_SHARES = (0.361, 0.341, 0.298)
SHARE_FEMALE = 0.463
SHARE_MALE = 0.537

# Run-name scopes without voice features, acoustic families, table rows and columns.
DEMOGRAPHIC_SCOPES = ["age_sex_only", "comorbidity_only", "age_sex_comorbidity"]
FEATURE_FAMILIES = ["all_features", "basic_acoustics", "egemaps", "spectral", "temporal"]
FAMILY_TITLES = {
    "spectral": "Spectral",
    "basic_acoustics": "Basic acoustics",
    "egemaps": "eGeMAPS",
    "temporal": "Temporal",
    "all_features": "All acoustic",
}

# Run states of the run store.
RUN_STATES = {1: "RUNNING", 2: "SCHEDULED", 3: "FINISHED", 4: "FAILED"}

# Origin years for ages.
REFERENCE_YEAR = 2025
CROWD_REFERENCE_YEAR = 2020
