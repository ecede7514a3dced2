"""Fixed values that must equal the source analysis for results to agree.

Everything in this module is a FIXED VALUE (thresholds, period tables,
token lists, request defaults). Logic lives elsewhere.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — calendar cleaning
# ---------------------------------------------------------------------------
EXCLUDED_LISTING_ID = 15268792          # listing removed before calendar features
AVAILABLE_TRUE_TEXT = "t"               # text boolean meaning "true"
CURRENCY_STRIP_PATTERN = "[$,]"         # characters removed from price text

# Period table: name -> months (1..12). Season classes are December-February,
# March-May, June-August, September-November; "year" has no month predicate.
PERIODS_PRODUCTION = {
    "year": None,
    "winter": (12, 1, 2),
    "spring": (3, 4, 5),
    "summer": (6, 7, 8),
    "fall": (9, 10, 11),
}
PERIODS_EXTENDED = {
    **PERIODS_PRODUCTION,
    "jan": (1,),
    "jun": (6,),
    "dec": (12,),
}
# measure name in the output column -> calendar column averaged
CALENDAR_MEASURES = {"available": "available", "min_nights": "minimum_nights", "price": "price"}

# Outlier band applied to every period average: measure -> (low, high), inclusive.
MIN_NIGHTS_MAX = 30.0
PRICE_MIN = 20.0
PRICE_MAX = 500.0
OUTLIER_BANDS = {"min_nights": (None, MIN_NIGHTS_MAX), "price": (PRICE_MIN, PRICE_MAX)}

# Year shift used by the exploration notebook: rows in this year move back 365 days.
SHIFT_YEAR = 2020
SHIFT_DAYS = 365

# ---------------------------------------------------------------------------
# FIXED VALUES — listing cleaning
# ---------------------------------------------------------------------------
KEPT_ROOM_TYPES = ("Entire home/apt", "Private room")
HOME_ROOM_TYPE = "Entire home/apt"
LISTING_CAPS = {"bedrooms": 10.0, "beds": 12.0, "bathrooms": 5.0}   # column -> inclusive max

# Amenity text normalisation. ASCII punctuation minus "-", "," and "/" is deleted
# (underscore included), then these replacements run in this order.
AMENITY_KEEP_PUNCT = "-,/"
AMENITY_REPLACEMENTS = (
    ("translation missing enhostingamenity49", ""),
    ("translation missing enhostingamenity50", ""),
    (",,", ","),
    ("’", ""),
    (" / ", " "),
    ("/", " "),
    (" ", "_"),
    ("-", "_"),
)
# Column renames applied after multi-hot encoding (raw token -> feature name).
AMENITY_RENAMES = {"24_hour_check_in": "all_day_check_in", "_toilet": "toilet"}

# ---------------------------------------------------------------------------
# FIXED VALUES — neighbour fill
# ---------------------------------------------------------------------------
NEIGHBOUR_LAT_HALF_WIDTH = 0.002
NEIGHBOUR_LON_HALF_WIDTH = 0.002
LISTING_FILL_COLUMNS = ("bathrooms", "bedrooms", "beds")               # rounded half-even
PRICE_FILL_COLUMNS = ("price_year_avg", "price_winter_avg", "price_spring_avg",
                      "price_summer_avg", "price_fall_avg")          # unrounded

# ---------------------------------------------------------------------------
# FIXED VALUES — price bins (right-closed): (0,50]->0 ... (350,400]->7, (400,inf)->8
# ---------------------------------------------------------------------------
PRICE_BIN_EDGES = (0, 50, 100, 150, 200, 250, 300, 350, 400)
HIGH_PRICE_THRESHOLD = 400.0

# ---------------------------------------------------------------------------
# FIXED VALUES — default profile: columns kept unrounded; columns removed
# ---------------------------------------------------------------------------
PROFILE_UNROUNDED = ("latitude", "longitude", "min_nights_year_avg", "available_year_avg")
PROFILE_EXCLUDED = (
    "price_year_avg", "price_winter_avg", "price_spring_avg", "price_summer_avg", "price_fall_avg",
    "available_winter_avg", "available_spring_avg", "available_summer_avg", "available_fall_avg",
    "min_nights_winter_avg", "min_nights_spring_avg", "min_nights_summer_avg", "min_nights_fall_avg",
)

# ---------------------------------------------------------------------------
# FIXED VALUES — models
# ---------------------------------------------------------------------------
GBT_PARAMS = {"maxDepth": 8, "maxIter": 200, "stepSize": 0.1}
FOREST_PARAMS = {"numTrees": 100, "maxDepth": 30, "featureSubsetStrategy": "all"}
STRATIFIED_SHARES = (0.6, 0.2, 0.2)
PERIOD_COMBOS = (("available_year_avg", "min_nights_year_avg", "price_year_avg"),)
KBEST_CANDIDATES = (125, 124, 123, 122, 121, 100, 75)

# ---------------------------------------------------------------------------
# FIXED VALUES — n-gram filter extra stop words (commented-out clean-token variant)
# ---------------------------------------------------------------------------
EXTRA_STOP_WORDS = ("ps", "hello", "go", "everyone", "s", "sf", "nt", "pmam", "wown", "see")

# ---------------------------------------------------------------------------
# FIXED VALUES — score request: scalar fields with their defaults, in order
# ---------------------------------------------------------------------------
REQUEST_SCALAR_DEFAULTS = (
    ("host_is_superhost", "int", 0),
    ("latitude", "double", 40.7282952399),
    ("longitude", "double", -73.9501208342),
    ("accommodates", "int", 3),
    ("bathrooms", "double", 1.0),
    ("bedrooms", "int", 1),
    ("beds", "int", 1),
    ("entire_home_apt", "int", 1),
)
# Amenity flags of the request, in order (all int, default 0 unless listed in AMENITY_DEFAULT_ON)
REQUEST_AMENITIES = (
    "all_day_check_in toilet accessible_height_bed accessible_height_toilet air_conditioning air_purifier "
    "baby_bath baby_monitor babysitter_recommendations bathtub bathtub_with_bath_chair bbq_grill "
    "beach_essentials beachfront bed_linens breakfast building_staff buzzer_wireless_intercom cable_tv "
    "carbon_monoxide_detector cats ceiling_hoist changing_table childrens_books_and_toys childrens_dinnerware "
    "cleaning_before_checkout coffee_maker cooking_basics crib disabled_parking_spot dishes_and_silverware "
    "dishwasher dogs doorman dryer electric_profiling_bed elevator essentials ethernet_connection ev_charger "
    "extra_pillows_and_blankets extra_space_around_bed family_kid_friendly fire_extinguisher fireplace_guards "
    "firm_mattress first_aid_kit fixed_grab_bars_for_shower fixed_grab_bars_for_toilet "
    "flat_path_to_guest_entrance free_parking_on_premises free_street_parking full_kitchen game_console "
    "garden_or_backyard ground_floor_access gym hair_dryer handheld_shower_head hangers heating high_chair "
    "host_greets_you hot_tub hot_water hot_water_kettle indoor_fireplace internet iron keypad kitchen "
    "kitchenette lake_access laptop_friendly_workspace lock_on_bedroom_door lockbox long_term_stays_allowed "
    "luggage_dropoff_allowed microwave mobile_hoist no_stairs_or_steps_to_enter other other_pets "
    "outlet_covers oven pack_n_play_travel_crib paid_parking_off_premises paid_parking_on_premises "
    "patio_or_balcony pets_allowed pets_live_on_this_property pocket_wifi pool pool_with_pool_hoist "
    "private_bathroom private_entrance private_living_room refrigerator room_darkening_shades safety_card "
    "self_check_in shampoo shower_chair single_level_home ski_in_ski_out smart_lock smoke_detector "
    "smoking_allowed stair_gates step_free_shower stove suitable_for_events table_corner_guards tv washer "
    "washer_dryer waterfront well_lit_path_to_entrance wheelchair_accessible wide_clearance_to_shower "
    "wide_doorway_to_guest_bathroom wide_entrance wide_entrance_for_guests wide_entryway wide_hallways wifi "
    "window_guards"
).split()
AMENITY_DEFAULT_ON = (
    "air_conditioning carbon_monoxide_detector essentials hair_dryer hangers heating hot_water iron kitchen "
    "laptop_friendly_workspace shampoo smoke_detector tv wifi"
).split()
REQUEST_TAIL_DEFAULTS = (
    ("pred_price_year_avg_bin", "int", 2),
    ("available_year_avg", "double", 0.309226983),
    ("min_nights_year_avg", "double", 5.5922012336),
)


def request_fields() -> list[tuple[str, str, object]]:
    """(name, type, default) for every model feature of a score request, in training order."""
    amen = [(a, "int", 1 if a in AMENITY_DEFAULT_ON else 0) for a in REQUEST_AMENITIES]
    return list(REQUEST_SCALAR_DEFAULTS) + amen + list(REQUEST_TAIL_DEFAULTS)

# ---------------------------------------------------------------------------
# FIXED VALUES — listing columns pruned right after the read (production job), in order
# ---------------------------------------------------------------------------
LISTING_PRUNE_COLUMNS = (
    "listing_url scrape_id last_scraped name space experiences_offered neighborhood_overview notes transit access "
    "interaction house_rules thumbnail_url medium_url picture_url xl_picture_url host_id host_url host_name "
    "host_location host_about host_response_time host_response_rate host_acceptance_rate host_since "
    "host_listings_count host_total_listings_count host_verifications host_thumbnail_url host_picture_url "
    "host_has_profile_pic host_identity_verified host_neighbourhood street neighbourhood city state zipcode market "
    "smart_location country_code country is_location_exact instant_bookable is_business_travel_ready license "
    "jurisdiction_names review_scores_value requires_license review_scores_communication bed_type weekly_price "
    "monthly_price security_deposit guests_included minimum_minimum_nights maximum_minimum_nights "
    "minimum_maximum_nights maximum_maximum_nights calendar_updated has_availability calendar_last_scraped "
    "number_of_reviews_ltm first_review last_review review_scores_accuracy review_scores_cleanliness "
    "review_scores_checkin review_scores_location cancellation_policy require_guest_profile_picture "
    "require_guest_phone_verification calculated_host_listings_count calculated_host_listings_count_entire_homes "
    "calculated_host_listings_count_private_rooms calculated_host_listings_count_shared_rooms cleaning_fee "
    "extra_people square_feet property_type minimum_nights_avg_ntm maximum_nights_avg_ntm price minimum_nights "
    "maximum_nights availability_30 availability_60 availability_90 availability_365 review_scores_rating "
    "number_of_reviews reviews_per_month summary neighbourhood_cleansed neighbourhood_group_cleansed"
).split()
# Columns removed from the merged table before profiling/training
MERGE_DROP_COLUMNS = ("id", "room_type", "description", "amenities")

# ---------------------------------------------------------------------------
# FIXED VALUES — Treebank-like word tokens of lower-case text without digits: rules in order, as (pattern, replacement) with
# \\1 for a group, in the syntax that Java and RE2 share. Words stand between blanks, two between neighbours. The private
# character U+E000 keeps a full stop or an apostrophe that stays with its word.
# ---------------------------------------------------------------------------
TOKEN_ABBREVIATIONS = ("mr mrs ms dr prof sr jr st ave blvd rd apt ste mt ft hwy bldg fl no vs etc approx min max hr hrs mi "
                       "sq inc co corp ltd dept est jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun").split()
TOKEN_RULES = (
    ("[\\x09-\\x0D\\x20]+", "  "),
    ("^|$", "  "),
    # quotes, brackets, punctuation other than full stops, dashes
    ("([\"“”„«»])", " \\1 "),
    ("(``|'')", " \\1 "),
    ("([,:;@#$%&?!])", " \\1 "),
    ("([\\[\\](){}<>])", " \\1 "),
    ("(\\.\\.+)", " \\1 "),
    ("(--+|—|–)", " \\1 "),
    # full stops: kept with abbreviations, initials and letters between stops; split off at the end of other words
    (f" ({'|'.join(TOKEN_ABBREVIATIONS)})\\. ", " \\1\ue000 "),
    (" ([a-z](?:\\.[a-z])*)\\. ", " \\1\ue000 "),
    ("([^. ])\\.(['’]*) ", "\\1 . \\2 "),
    ("\ue000", "."),
    # apostrophes: the clitics are words, quotes around words go apart
    (" '(t)(is|was) ", " \ue000\\1 \\2 "),
    (" '([^' ])", " ' \\1"),
    ("\ue000", "'"),
    ("([^' ])(n't|'s|'m|'d|'ll|'re|'ve) ", "\\1 \\2 "),
    (" (can)(not) ", " \\1 \\2 "),
    (" (gon|wan)(na) ", " \\1 \\2 "),
    (" (got)(ta) ", " \\1 \\2 "),
    (" (gim|lem)(me) ", " \\1 \\2 "),
    ("([^' ])' ", "\\1 ' "),
)
# The same rules as fewer and quicker passes over a text, in Java's syntax: rules for unlike characters are one, a rare
# character is looked for before what stands in front of it, plain strings are replaced without a pattern (None). More than
# two blanks are as good as two. The second rule is the caller's: two blanks at either end, and before a last line end.
TOKEN_LAST_LINE_END = "([\\x{85}\\x{2028}\\x{2029}])\\z"
TOKEN_PASSES = (
    *[(None, (blank, "  ")) for blank in " \t\n\x0b\x0c\r"],
    ("((?![a-z ])(?:[\"“”„«»,:;@#$%&?!\\[\\](){}<>—–]|``|''|\\.\\.+|--+))", " $1 "),
    (f"\\.(?<= (?:{'|'.join(TOKEN_ABBREVIATIONS)})\\.) ", "\ue000 "),
    (" ([a-z](?:\\.[a-z])*)\\. ", " $1\ue000 "),
    ("\\.(?<=[^. ]\\.)(['’]*) ", " . $1 "),
    (None, ("\ue000", ".")),
    (" '(t)(is|was) ", " \ue000$1 $2 "),
    (" '([^' ])", " ' $1"),
    (None, ("\ue000", "'")),
    ("(n(?<=[^' ]n)'t|'(?<=[^' ]')(?:s|m|d|ll|re|ve)) ", " $1 "),
    (" (can(?=not )|gon(?=na )|wan(?=na )|got(?=ta )|gim(?=me )|lem(?=me ))(not|na|ta|me) ", " $1 $2 "),
    ("' (?<=[^' ]' )", " ' "),
)
TOKEN_KEPT = "[\\p{L}\\p{N}]"
TOKEN_DROPPED = " [^ \\p{L}\\p{N}]++(?= )"  # words that TOKEN_KEPT is not in, in a text of words between blanks

# ---------------------------------------------------------------------------
# FIXED VALUES — English stop words (Spark ML StopWordsRemover default list), in order
# ---------------------------------------------------------------------------
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is are "
    "was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out "
    "on off over under again further then once here there when where why how all any both each few more most "
    "other some such no nor not only own same so than too very s t can will just don should now i'll you'll "
    "he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've "
    "we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't "
    "shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's "
    "where's who's why's would"
).split()
