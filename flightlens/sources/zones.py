"""Geofence zones: the table's schema, the built-in presets and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "zone_pos int, zone_id string, name string, zone_type string, coordinates array<array<double>>, center_lat double, center_lon double, "
    "radius_meters double, max_altitude_m double, active_from timestamp, active_to timestamp, is_preconfigured_nofly boolean, "
    "category string, zone_class string, authority string, city_region string, description string"
)

#: Id, name, category, latitude, longitude, radius, authority, region and description of the circular presets.
CIRCLES = (
    ("ZONE-AIRPORT-BOM", "Chhatrapati Shivaji Maharaj International Airport (BOM/VABB)", "AIRPORT", 19.0896, 72.8656, 15000.0, "DGCA / AAI / MIAL", "Mumbai / MMR", "DGCA Red Zone under Drone Rules 2021: Within 5 km of international airport perimeter. Absolute UAV prohibition."),
    ("ZONE-AIRPORT-DEL", "Indira Gandhi International Airport (DEL/VIDP)", "AIRPORT", 28.5562, 77.1, 8000.0, "DGCA / AAI / DIAL", "Delhi NCR", "National Capital International Airport Red Zone. Critical civil aviation terminal exclusion zone."),
    ("ZONE-AIRPORT-BLR", "Kempegowda International Airport Bengaluru (BLR/VOBL)", "AIRPORT", 13.1986, 77.7066, 8000.0, "DGCA / BIAL / AAI", "Bengaluru", "Devenahalli Civil Aviation Hub Red Zone. Strict 8 km no-drone exclusion boundary."),
    ("ZONE-AIRPORT-HYD", "Rajiv Gandhi International Airport (HYD/VOHS)", "AIRPORT", 17.2403, 78.4294, 8000.0, "DGCA / GHIAL / AAI", "Hyderabad", "Shamshabad International Airport Red Zone. Full airspace restriction under DGCA mandate."),
    ("ZONE-AIRPORT-MAA", "Chennai International Airport (MAA/VOMM)", "AIRPORT", 12.9941, 80.1709, 8000.0, "DGCA / AAI", "Chennai", "Meenambakkam Civil Airport and Obstacle Limitation Surface (OLS) Red Zone."),
    ("ZONE-AIRPORT-CCU", "Netaji Subhash Chandra Bose International Airport (CCU/VECC)", "AIRPORT", 22.6547, 88.4467, 8000.0, "DGCA / AAI", "Kolkata", "Dum Dum Civil Aviation Red Zone. Eastern India primary international aerial corridor."),
    ("ZONE-AIRPORT-PNQ", "Pune International Airport & Civil Enclave (PNQ/VAPO)", "AIRPORT", 18.5822, 73.9197, 5000.0, "DGCA / IAF / AAI", "Maharashtra", "Joint Civil Aviation Enclave & Indian Air Force Lohegaon Base. Complete Red Zone."),
    ("ZONE-AIRPORT-GOI", "Goa Dabolim International Airport (GOI/VAGO)", "AIRPORT", 15.3808, 73.8313, 5000.0, "Indian Navy / AAI / DGCA", "Goa", "Dual-use Military / Civil Airport at INS Hansa Naval Base. High security no-fly perimeter."),
    ("ZONE-AIRPORT-GOX", "Manohar International Airport Mopa (GOX/VOGA)", "AIRPORT", 15.755, 73.864, 5000.0, "DGCA / GGIAL", "Goa", "North Goa International Greenfield Airport Red Zone."),
    ("ZONE-AIRPORT-AMD", "Sardar Vallabhbhai Patel International Airport (AMD/VAAH)", "AIRPORT", 23.0772, 72.6347, 5000.0, "DGCA / Adani Airports / AAI", "Gujarat", "Hansol Ahmedabad Civil Airport Red Zone."),
    ("ZONE-AIRDROME-VAJJ", "Juhu Aerodrome (VAJJ, Mumbai)", "AIRDROME", 19.0975, 72.8339, 3000.0, "AAI / DGCA", "Mumbai / MMR", "India's premier civil helicopter hub and general aviation aerodrome. Intensive rotorcraft corridor."),
    ("ZONE-AIRDROME-VIDD", "Safdarjung Airport & Flying Club (VIDD, New Delhi)", "AIRDROME", 28.5843, 77.2081, 3000.0, "AAI / DGCA / Ministry of Civil Aviation", "Delhi NCR", "Historic civil aerodrome and VIP helicopter transit hub adjacent to Lutyens Delhi."),
    ("ZONE-AIRDROME-ROHINI", "Pawan Hans Rohini Heliport (Delhi)", "AIRDROME", 28.746, 77.068, 2500.0, "Pawan Hans / AAI", "Delhi NCR", "Dedicated commercial helicopter operational facility and maintenance base."),
    ("ZONE-AIRDROME-HAL", "HAL Airport & Aerodrome (VOBG, Bengaluru)", "AIRDROME", 12.95, 77.6682, 4000.0, "Hindustan Aeronautics Limited / MoD", "Bengaluru", "HAL flight testing aerodrome, VVIP military flights, and aerospace research facility."),
    ("ZONE-AIRDROME-BEGUMPET", "Begumpet Airport & Air Force Academy Transit (VOHY, Hyderabad)", "AIRDROME", 17.4531, 78.4676, 4000.0, "AAI / DGCA", "Hyderabad", "Civil aviation training, VIP transit, and Telangana State Aviation Academy aerodrome."),
    ("ZONE-AIRDROME-HADAPSAR", "Hadapsar Gliding Centre (Pune)", "AIRDROME", 18.508, 73.928, 2000.0, "DGCA", "Maharashtra", "DGCA civil aviation gliding airfield and low-altitude unpowered aircraft sector."),
    ("ZONE-MIL-SHIKRA", "INS Shikra Naval Air Station (Colaba, Mumbai)", "MILITARY_AIRFORCE", 18.9042, 72.8174, 3000.0, "Indian Navy / Ministry of Defence", "Mumbai / MMR", "Headquarters Western Fleet Naval Air Station. Strict statutory military exclusion zone under MoD."),
    ("ZONE-MIL-HINDON", "Hindon Air Force Station (VABP, Ghaziabad/NCR)", "MILITARY_AIRFORCE", 28.7067, 77.3592, 5000.0, "Indian Air Force (IAF) / MoD", "Delhi NCR", "Asia's largest air base. Strategic heavy airlift (C-17, C-130J) and air defense base."),
    ("ZONE-MIL-YELAHANKA", "Yelahanka Air Force Station (Bengaluru)", "MILITARY_AIRFORCE", 13.1355, 77.6061, 5000.0, "Indian Air Force (IAF)", "Bengaluru", "IAF Pilot Training Command & Aero India venue. Heavy defense transport flight operations."),
    ("ZONE-MIL-AMBALA", "Ambala Air Force Station (Rafale Golden Arrows Base)", "MILITARY_AIRFORCE", 30.3689, 76.8172, 5000.0, "Indian Air Force (IAF) / MoD", "Northern India", "Frontline IAF Tactical Fighter Wing base. High alert national security airspace."),
    ("ZONE-MIL-TAMBARAM", "Tambaram Air Force Station (Chennai)", "MILITARY_AIRFORCE", 12.907, 80.123, 4000.0, "Indian Air Force (IAF)", "Chennai", "IAF Flying Instructors School & mechanical training airbase."),
    ("ZONE-GOV-CENTRALVISTA", "Central Vista, Parliament & Rashtrapati Bhavan (New Delhi)", "GOVERNMENT", 28.6143, 77.1994, 3500.0, "Ministry of Home Affairs / Delhi Police / SPG", "Delhi NCR", "Seat of the Union Government: Parliament House, PMO, North/South Block, and President's Estate. Absolute Red Zone."),
    ("ZONE-GOV-MANTRALAYA", "Mantralaya & Vidhan Bhavan Complex (Nariman Point, Mumbai)", "GOVERNMENT", 18.927, 72.8275, 1500.0, "Govt of Maharashtra / Mumbai Police", "Mumbai / MMR", "Administrative Secretariat and Legislative Assembly of Maharashtra. Permanent high-security zone."),
    ("ZONE-GOV-RAJBHAVAN-MUM", "Raj Bhavan Estate (Malabar Hill, Mumbai)", "GOVERNMENT", 18.943, 72.796, 1500.0, "Raj Bhavan Secretariat / Mumbai Police", "Mumbai / MMR", "Official gubernatorial estate of Maharashtra. Coastal security perimeter."),
    ("ZONE-GOV-VIDHANASOUDHA", "Vidhana Soudha & High Court of Karnataka (Bengaluru)", "GOVERNMENT", 12.9791, 77.5913, 2000.0, "Govt of Karnataka / Bengaluru Police", "Bengaluru", "Seat of Karnataka State Legislature and High Court. Designated high-security airspace."),
    ("ZONE-GOV-FORTSTGEORGE", "Fort St. George Secretariat & Legislative Assembly (Chennai)", "GOVERNMENT", 13.08, 80.2872, 2000.0, "Govt of Tamil Nadu / Indian Army", "Chennai", "Tamil Nadu State Secretariat and Military Station perimeter."),
    ("ZONE-GOV-SUPREMECOURT", "Supreme Court of India (Tilak Marg, New Delhi)", "GOVERNMENT", 28.6225, 77.2393, 1000.0, "Supreme Court Registry / Delhi Police", "Delhi NCR", "Apex Judicial Complex. Protected institutional airspace perimeter."),
    ("ZONE-GOV-BOMBAYHC", "Bombay High Court Heritage Precinct (Fort, Mumbai)", "GOVERNMENT", 18.9298, 72.8302, 1000.0, "High Court Administration / Mumbai Police", "Mumbai / MMR", "Historic High Court of Judicature and judicial complex no-fly zone."),
    ("ZONE-STRAT-BARC", "Bhabha Atomic Research Centre (BARC Trombay, Mumbai)", "STRATEGIC_NUCLEAR", 19.0067, 72.9189, 3500.0, "Department of Atomic Energy (DAE) / CISF", "Mumbai / MMR", "Primary nuclear research facility and reactors under Atomic Energy Act, 1962. Permanent statutory Red Zone."),
    ("ZONE-STRAT-NAVALDOCK", "Mumbai Naval Dockyard & Western Naval Command HQ", "STRATEGIC_NUCLEAR", 18.9248, 72.8378, 2500.0, "Indian Navy / Ministry of Defence", "Mumbai / MMR", "Strategic maritime warship and submarine repair docks at Lion Gate, Mumbai Harbour."),
    ("ZONE-STRAT-ISRO-URSC", "ISRO UR Rao Satellite Centre (URSC, Bengaluru)", "STRATEGIC_NUCLEAR", 12.9664, 77.6588, 2000.0, "ISRO / Department of Space / CISF", "Bengaluru", "Lead national centre for design, fabrication, and testing of communication & interplanetary spacecraft."),
    ("ZONE-STRAT-SHAR", "Satish Dhawan Space Centre (SDSC SHAR, Sriharikota)", "STRATEGIC_NUCLEAR", 13.7199, 80.2304, 8000.0, "ISRO / Ministry of Home Affairs / CISF", "Southern India", "India's spaceport and orbital rocket launch complex (PSLV/GSLV/LVM3). Absolute no-fly zone."),
    ("ZONE-STRAT-KALPAKKAM", "Madras Atomic Power Station (MAPS, Kalpakkam)", "STRATEGIC_NUCLEAR", 12.5574, 80.175, 5000.0, "Nuclear Power Corporation of India (NPCIL) / DAE", "Chennai", "Nuclear power plant and fast breeder test reactor facility exclusion zone."),
    ("ZONE-STRAT-MAHUL", "BPCL & HPCL Mahul Refineries Complex (Chembur, Mumbai)", "STRATEGIC_NUCLEAR", 19.015, 72.89, 2500.0, "Ministry of Petroleum & Natural Gas / CISF", "Mumbai / MMR", "Critical petrochemical and hydrocarbon refining infrastructure. Hazardous industrial no-drone perimeter."),
    ("ZONE-PRISON-ARTHUR", "Arthur Road Central Prison (Mumbai Central Jail)", "PRISON", 18.9862, 72.8306, 1000.0, "Maharashtra Prisons Department", "Mumbai / MMR", "High-security correctional facility. Statutory ban on aerial surveillance and contraband delivery."),
    ("ZONE-PRISON-TIHAR", "Tihar Central Prison Complex (New Delhi)", "PRISON", 28.6253, 77.1128, 1500.0, "Delhi Prisons Dept / CISF", "Delhi NCR", "South Asia's largest prison complex. Permanent exclusion zone."),
    ("ZONE-PRISON-YERWADA", "Yerwada Central Jail (Pune)", "PRISON", 18.5526, 73.8827, 1500.0, "Maharashtra Prisons Dept", "Maharashtra", "Historic maximum-security prison and perimeter zone."),
    ("ZONE-INTL-DCP56A", "Washington D.C. Flight Restricted Zone (P-56A / White House / Capitol / Pentagon)", "GOVERNMENT", 38.8977, -77.0365, 5000.0, "FAA / US Secret Service / NORAD", "International (USA)", "United States National Defense Airspace / FRZ. Prohibited airspace Area P-56A."),
    ("ZONE-INTL-LHR", "London Heathrow Airport (LHR / EGLL) & Westminster EG R157", "AIRPORT", 51.47, -0.4543, 5000.0, "UK Civil Aviation Authority (CAA) / NATS", "International (UK)", "UK CAA Flight Restriction Zone (FRZ) around Heathrow runway approach paths and terminals."),
    ("ZONE-INTL-DXB", "Dubai International Airport (DXB / OMDB)", "AIRPORT", 25.2532, 55.3657, 5000.0, "Dubai Civil Aviation Authority (DCAA)", "International (UAE)", "GCAA / DCAA Red Zone exclusion around DXB runways and international terminal approaches."),
    ("ZONE-INTL-CHANGI", "Singapore Changi Airport (SIN / WSSS)", "AIRPORT", 1.3644, 103.9915, 5000.0, "Civil Aviation Authority of Singapore (CAAS)", "International (Singapore)", "CAAS 5 km Protected Aerodrome Zone around Singapore Changi Airport."),
)
#: Fixed values of the polygonal preset, vertices as latitude and longitude.
BUFFER_RING = ((19.1410, 72.9050), (19.1410, 72.9230), (19.1250, 72.9230), (19.1250, 72.9050))
BUFFER = ("ZONE-BUFFER-IITB", "IIT Bombay Powai Campus Airspace Perimeter", "CONTROLLED_BUFFER", "IIT Bombay Security / DGCA", "Academic & Research Airspace Sector. Maximum permitted flight altitude 60m AGL.")
#: Its place in the catalog.
BUFFER_POS = 37
BUFFER_CEILING_M = 60.0
REGION = "Mumbai / MMR"
#: Zones a new case starts with.
DEFAULT_IDS = ("ZONE-AIRPORT-BOM",)


def preset_rows() -> list[tuple]:
    """The presets as rows of SCHEMA, in catalog order: circles forbid all flight, the buffer has a ceiling."""
    rows = [(z, name, "circle", None, lat, lon, r, 0.0, None, None, True, cat, "RED", auth, region, text) for z, name, cat, lat, lon, r, auth, region, text in CIRCLES]
    zone, name, cat, auth, text = BUFFER
    ring = [list(v) for v in BUFFER_RING]
    rows.insert(BUFFER_POS, (zone, name, "polygon", ring, None, None, None, BUFFER_CEILING_M, None, None, False, cat, "YELLOW", auth, REGION, text))
    return [(i, *row) for i, row in enumerate(rows)]


def zone_catalog(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The zone table: a Parquet catalog of SCHEMA at `path`, or the built-in presets."""
    if path:
        return spark.read.schema(SCHEMA).parquet(path)
    return spark.createDataFrame(preset_rows(), SCHEMA)


def filter_zones(zones: DataFrame, category: str | None = None, region: str | None = None) -> DataFrame:
    """Zones of a category and region; None or ALL filters nothing."""
    for column, wanted in (("category", category), ("city_region", region)):
        if wanted and wanted != "ALL":
            zones = zones.filter(F.col(column) == wanted)
    return zones


def zone_by_id(zones: DataFrame, zone_id: str) -> DataFrame:
    return zones.filter(F.col("zone_id") == zone_id)


def search_zones(zones: DataFrame, text: str) -> DataFrame:
    """Zones with the text, in any case, in a describing field."""
    return zones.filter(F.lower(F.concat_ws(" ", "zone_id", "name", "category", "authority", "city_region", "description")).contains(text.lower()))


def upsert_zones(zones: DataFrame, new: DataFrame) -> DataFrame:
    """New zones replace those of the same id and go behind all others."""
    behind = zones.agg(F.coalesce(F.max("zone_pos"), F.lit(-1)).alias("last"))
    kept = zones.join(new.select("zone_id"), "zone_id", "left_anti").select(*zones.columns)
    # One aggregate row beside the new zones, which are few.
    moved = new.join(F.broadcast(behind)).withColumn("zone_pos", (F.col("zone_pos") + F.col("last") + 1).cast("int")).select(*zones.columns)
    return kept.unionByName(moved)


def import_zones(zones: DataFrame, catalog: DataFrame, ids: list[str]) -> DataFrame:
    """Upserts the catalog's zones of these ids."""
    return upsert_zones(zones, catalog.filter(F.col("zone_id").isin(ids)))


def load_all(zones: DataFrame, catalog: DataFrame) -> DataFrame:
    """zones with every catalog zone whose id is not there yet behind them, and `added` telling which are new."""
    return zones.withColumn("added", F.lit(False)).unionByName(catalog.join(zones.select("zone_id"), "zone_id", "left_anti").select(*zones.columns).withColumn("added", F.lit(True)))
