"""Names, defaults and word lists the results depend on."""

# Features compared between forecast and history.
FEATURES = ["temp", "min_temp", "max_temp", "rainfall", "humidity"]

# Measures that cleaning coerces and interpolates.
MEASURES = ["temp", "min_temp", "max_temp", "rainfall", "humidity", "soil_ph"]

# Source column name -> internal column name.
ALIASES = {
    "temperature": "temp",
    "t2m": "temp",
    "t2m_min": "min_temp",
    "t2m_max": "max_temp",
    "prectotcorr": "rainfall",
    "rh2m": "humidity",
    "label": "crop",
    "ph": "soil_ph",
}

# Readings that mean "missing".
SENTINELS = [-999.0, -9999.0]

# What a measure becomes when a whole series is missing.
MEASURE_DEFAULTS = {
    "temp": 25.0,
    "min_temp": 20.0,
    "max_temp": 30.0,
    "rainfall": 0.0,
    "humidity": 65.0,
    "soil_ph": 6.5,
}

# What a 3-hourly forecast field becomes when it is absent.
FORECAST_DEFAULTS = {
    "temp": 20.0,
    "min_temp": 15.0,
    "max_temp": 25.0,
    "rainfall": 0.0,
    "humidity": 60.0,
}

# Daily water need in millimetres.
WATER_NEED_MM = {
    "rice": 8.0,
    "wheat": 4.2,
    "maize": 5.5,
    "cotton": 6.0,
    "soybean": 5.0,
    "millet": 3.5,
}
DEFAULT_WATER_NEED_MM = 4.5

# What a schedule day shows for a missing field.
SCHEDULE_DEFAULTS = {
    "temp": 25.0,
    "rainfall": 0.0,
    "humidity": 60.0,
    "similarity_score": 75.0,
    "risk_level": "medium",
}

# Season lengths in days when no hint is known.
DEFAULT_DURATION = 100

# Planting-advice defaults for fields left empty.
ADVICE_DEFAULTS = {
    "water_availability": 500.0,
    "land_area": 1.0,
    "forecast_days": 30,
    "soil_ph": 6.5,
}

# Crops always offered next to the requested one.
ADVICE_CROPS = ["rice", "wheat", "maize", "millet"]
BATCH_CROPS = ["rice", "wheat", "maize", "soybean", "cotton"]

# Other names of a crop.
CROP_SYNONYMS = {
    "paddy": "rice",
    "basmati rice": "rice",
    "pigeon pea": "pigeonpeas",
    "toor dal": "pigeonpeas",
    "chana": "chickpea",
    "corn": "maize",
    "lady finger": "okra",
    "brinjal": "eggplant",
    "pearl millet": "bajra",
    "finger millet": "ragi",
    "sorghum": "jowar",
}

# Crop names offered in the catalogue.
CATALOGUE_CROPS = [
    "Rice", "Basmati Rice", "Paddy", "Wheat", "Bajra (Pearl Millet)",
    "Ragi (Finger Millet)", "Jowar (Sorghum)", "Foxtail Millet", "Kodo Millet",
    "Barnyard Millet", "Little Millet", "Toor Dal (Pigeon Pea)", "Urad Dal",
    "Moong Dal", "Chana (Chickpea)", "Masoor Dal", "Groundnut", "Mustard",
    "Sunflower", "Sesame", "Soybean", "Castor", "Sugarcane", "Cotton", "Jute",
    "Tea", "Coffee", "Rubber", "Coconut", "Arecanut", "Tomato", "Potato",
    "Onion", "Brinjal (Eggplant)", "Cabbage", "Cauliflower",
    "Okra (Lady Finger)", "Carrot", "Beetroot", "Chilli", "Mango", "Banana",
    "Apple", "Orange", "Grapes", "Guava", "Papaya", "Pomegranate",
    "Watermelon", "Turmeric", "Black Pepper", "Cardamom", "Clove", "Coriander",
    "Cumin", "Fenugreek", "Ginger", "Maize (Corn)", "Saffron", "Cocoa",
    "Aloe Vera", "Medicinal Plants",
]

# Texts of the season schedule.
STAGES = [
    # (share of the season up to which it lasts, stage, daily activity)
    (0.15, "Germination & Emergence",
     "Ensure stable moisture for seed sprouting; inspect soil crusting."),
    (0.45, "Vegetative Growth",
     "Monitor leaf area development; apply nitrogen-rich fertilizer."),
    (0.75, "Flowering & Pollination",
     "Critical reproductive phase: prevent water stress at all costs."),
    (None, "Yield Formation & Ripening",
     "Prepare for grain filling; gradually reduce watering frequency."),
]
NO_IRRIGATION_TEXT = "No irrigation required: forecast rainfall meets crop requirements."
IRRIGATION_TEXT = "Apply %s mm of targeted irrigation."
RISK_TEXTS = {
    "high": "WARNING: Extreme weather deviation! Implement emergency water-saving mulching.",
    "medium": "Alert: Moderate climatic stress detected. Monitor soil moisture levels closely.",
}
TASK_DAYS = [
    ([7, 21], "Apply NPK balanced fertilizers to support growth cycle."),
    ([12, 26], "Perform manual or organic weeding around root zones."),
]
