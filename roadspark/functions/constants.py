"""Classes, speeds, ranks, tables and limits that results depend on."""

EARTH_RADIUS_M = 6378137.0
VEHICLE_CLASSES = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street", "service")
EXCLUDED_CLASSES = ("footway", "path", "steps", "track", "cycleway", "pedestrian", "bridleway", "construction", "proposed", "platform", "elevator", "corridor", "razed", "raceway")
INTERESTING_TAGS = ("highway", "railway", "traffic_signals", "traffic_calming")
TRIM_M, SHORT_CONNECTOR_M, GROUP_SPAN_M = 2.5, 10.0, 20.0
SPEED_KMH = {"motorway": 90.0, "trunk": 60.0, "primary": 60.0, "secondary": 60.0, "tertiary": 60.0, "unclassified": 60.0, "motorway_link": 45.0, "trunk_link": 30.0, "primary_link": 30.0, "secondary_link": 30.0, "tertiary_link": 30.0, "residential": 35.0, "living_street": 27.0, "service": 35.0}
DEFAULT_SPEED_KMH = 30.0
TURN_SPEED_KMH = 15.0
ROAD_RANK = {"motorway": 6, "motorway_link": 6, "trunk": 5, "trunk_link": 5, "primary": 4, "primary_link": 4, "secondary": 3, "secondary_link": 3, "tertiary": 2, "tertiary_link": 2, "unclassified": 1, "residential": 1, "living_street": 1, "service": 1}
LANE_WIDTH_M = 3.2
UTURN_DOT, RIGHT_ANGLE_RAD = -0.7, -0.1
MOVEMENT_FACTOR = {"through": 1.0, "right": 0.55, "uturn": 0.35}
ROAD_TIER = {"trunk": "trunk", "trunk_link": "trunk", "primary": "primary", "primary_link": "primary", "secondary": "secondary", "secondary_link": "secondary", "tertiary": "secondary", "tertiary_link": "secondary"}
RETAG_CELL_M, COMMERCIAL_M, APARTMENTS_M, INDUSTRIAL_M2 = 40.0, 60.0, 150.0, 250.0
AMENITY_BUILDING = {
    "hospital": "hospital", "clinic": "clinic", "doctors": "clinic", "dentist": "clinic", "blood_bank": "hospital", "pharmacy": "retail", "place_of_worship": "religious",
    "school": "school", "college": "school", "university": "school", "kindergarten": "school", "police": "civic", "fire_station": "civic", "post_office": "civic", "public_building": "civic",
    "townhall": "civic", "community_centre": "civic", "social_centre": "civic", "events_venue": "civic", "theatre": "civic", "toilets": "civic", "shelter": "civic", "studio": "commercial",
    "bank": "commercial", "atm": "commercial", "conference_centre": "commercial", "fast_food": "retail", "restaurant": "retail", "cafe": "retail", "food_court": "retail", "bar": "retail",
    "pub": "retail", "marketplace": "retail", "fuel": "retail",
}
TOURISM_BUILDING = {"hotel": "hotel", "guest_house": "hotel", "motel": "hotel", "hostel": "hotel"}
VEHICLE_TYPES = ("car", "motorcycle", "bus", "truck", "ambulance", "firetruck", "police")
EMERGENCY_TYPES = ("ambulance", "firetruck", "police")
VEHICLE_MIX = {"car": 0.82, "motorcycle": 0.10, "bus": 0.03, "truck": 0.03, "ambulance": 0.02, "firetruck": 0.015, "police": 0.015}
DENSITY_WEIGHT = {"bus": 10.0, "truck": 0.1, "motorcycle": 0.5}
STUCK_SPEED_MPS, STUCK_SEC = 0.5, 5.0
LIVE_TIMEOUT_SEC = 20.0
EMA_ALPHA = 0.1
PREEMPT_GAP_SEC, PREEMPT_CLEAR_SEC = 5.0, 5.0
PAIRED_STEP_SEC, PAIRED_YELLOW_SEC, GROUP_TURN_SEC = 15.0, 3.0, 30.0
