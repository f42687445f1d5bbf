"""Fixed data contracts of the event model.

FIXED VALUES: the names below are the public column contracts of the enriched
event format and of the modelled tables (positional TSV field order, entity
column names and their fields, output column order).  They must equal the
originals for results to line up, so they are stated here verbatim, in their
natural order.
"""

# --- FIXED VALUES: output column order of each modelled table -----------------
VIEWS_COLUMNS = (
    'view_id', 'event_name', 'event_id', 'session_identifier', 'view_in_session_index',
    'views_in_session', 'user_id', 'user_identifier', 'stitched_user_id', 'network_userid',
    'dvce_created_tstamp', 'collector_tstamp', 'derived_tstamp', 'start_tstamp',
    'end_tstamp', 'model_tstamp', 'app_id', 'platform', 'device_identifier',
    'device_category', 'device_session_index', 'os_version', 'os_type',
    'mobile__device_manufacturer', 'mobile__device_model', 'mobile__os_type',
    'mobile__os_version', 'mobile__android_idfa', 'mobile__apple_idfa',
    'mobile__apple_idfv', 'mobile__carrier', 'mobile__open_idfa',
    'mobile__network_technology', 'mobile__network_type', 'mobile__physical_memory',
    'mobile__system_available_memory', 'mobile__app_available_memory',
    'mobile__battery_level', 'mobile__battery_state', 'mobile__low_power_mode',
    'mobile__available_storage', 'mobile__total_storage', 'mobile__is_portrait',
    'mobile__resolution', 'mobile__scale', 'mobile__language', 'mobile__app_set_id',
    'mobile__app_set_id_scope', 'screen_resolution', 'geo_country', 'geo_region',
    'geo_region_name', 'geo_city', 'geo_zipcode', 'geo_latitude', 'geo_longitude',
    'geo_timezone', 'user_ipaddress', 'engaged_time_in_s', 'absolute_time_in_s',
    'horizontal_pixels_scrolled', 'vertical_pixels_scrolled',
    'horizontal_percentage_scrolled', 'vertical_percentage_scrolled', 'mkt_medium',
    'mkt_source', 'mkt_term', 'mkt_content', 'mkt_campaign', 'mkt_clickid', 'mkt_network',
    'default_channel_group', 'page_url', 'page_referrer', 'refr_medium', 'refr_source',
    'refr_term', 'br_colordepth', 'br_lang', 'br_viewwidth', 'br_viewheight',
    'br_renderengine', 'doc_width', 'doc_height', 'page_title', 'page_urlscheme',
    'page_urlhost', 'page_urlpath', 'page_urlquery', 'page_urlfragment', 'refr_urlscheme',
    'refr_urlhost', 'refr_urlpath', 'refr_urlquery', 'refr_urlfragment', 'os_timezone',
    'content_group', 'iab__category', 'iab__primary_impact', 'iab__reason',
    'iab__spider_or_robot', 'yauaa__device_class', 'yauaa__agent_class',
    'yauaa__agent_name', 'yauaa__agent_name_version', 'yauaa__agent_name_version_major',
    'yauaa__agent_version', 'yauaa__agent_version_major', 'yauaa__device_brand',
    'yauaa__device_name', 'yauaa__device_version', 'yauaa__layout_engine_class',
    'yauaa__layout_engine_name', 'yauaa__layout_engine_name_version',
    'yauaa__layout_engine_name_version_major', 'yauaa__layout_engine_version',
    'yauaa__layout_engine_version_major', 'yauaa__operating_system_class',
    'yauaa__operating_system_name', 'yauaa__operating_system_name_version',
    'yauaa__operating_system_version', 'ua__useragent_family', 'ua__useragent_major',
    'ua__useragent_minor', 'ua__useragent_patch', 'ua__useragent_version', 'ua__os_family',
    'ua__os_major', 'ua__os_minor', 'ua__os_patch', 'ua__os_patch_minor', 'ua__os_version',
    'ua__device_family', 'session__previous_session_id', 'screen_view__name',
    'screen_view__previous_id', 'screen_view__previous_name', 'screen_view__previous_type',
    'screen_view__transition_type', 'screen_view__type', 'app__build', 'app__version',
    'geo__latitude', 'geo__longitude', 'geo__latitude_longitude_accuracy', 'geo__altitude',
    'geo__altitude_accuracy', 'geo__bearing', 'geo__speed', 'screen__fragment',
    'screen__top_view_controller', 'screen__view_controller', 'useragent', 'v_collector',
)

SESSIONS_COLUMNS = (
    'first_event_name', 'last_event_name', 'session_identifier', 'user_id',
    'user_identifier', 'stitched_user_id', 'network_userid', 'start_tstamp', 'end_tstamp',
    'model_tstamp', 'app_id', 'platform', 'device_identifier', 'device_category',
    'device_session_index', 'os_version', 'os_type', 'os_timezone', 'screen_resolution',
    'mobile__device_manufacturer', 'mobile__device_model', 'mobile__os_type',
    'mobile__os_version', 'mobile__android_idfa', 'mobile__apple_idfa',
    'mobile__apple_idfv', 'mobile__carrier', 'mobile__open_idfa',
    'mobile__network_technology', 'mobile__network_type', 'mobile__physical_memory',
    'mobile__system_available_memory', 'mobile__app_available_memory',
    'mobile__battery_level', 'mobile__battery_state', 'mobile__low_power_mode',
    'mobile__available_storage', 'mobile__total_storage', 'mobile__is_portrait',
    'mobile__resolution', 'mobile__scale', 'mobile__language', 'mobile__app_set_id',
    'mobile__app_set_id_scope', 'mobile_language_name', 'first_geo_country',
    'first_geo_region_name', 'first_geo_city', 'first_geo_country_name',
    'first_geo_continent', 'last_geo_country', 'last_geo_region_name', 'last_geo_city',
    'last_geo_country_name', 'last_geo_continent', 'geo_zipcode', 'geo_latitude',
    'geo_longitude', 'geo_timezone', 'user_ipaddress', 'views', 'event_counts',
    'event_counts_string', 'total_events', 'is_engaged', 'engaged_time_in_s',
    'absolute_time_in_s', 'mkt_medium', 'mkt_source', 'mkt_term', 'mkt_content',
    'mkt_campaign', 'mkt_clickid', 'mkt_network', 'default_channel_group',
    'mkt_source_platform', 'first_page_url', 'last_page_url', 'page_referrer',
    'refr_medium', 'refr_source', 'refr_term', 'first_page_title', 'first_page_urlscheme',
    'first_page_urlhost', 'first_page_urlpath', 'first_page_urlquery',
    'first_page_urlfragment', 'last_page_title', 'last_page_urlscheme', 'last_page_urlhost',
    'last_page_urlpath', 'last_page_urlquery', 'last_page_urlfragment', 'refr_urlscheme',
    'refr_urlhost', 'refr_urlpath', 'refr_urlquery', 'refr_urlfragment', 'br_renderengine',
    'first_br_lang', 'first_br_lang_name', 'last_br_lang', 'last_br_lang_name',
    'iab__category', 'iab__primary_impact', 'iab__reason', 'iab__spider_or_robot',
    'yauaa__device_class', 'yauaa__agent_class', 'yauaa__agent_name',
    'yauaa__agent_name_version', 'yauaa__agent_name_version_major', 'yauaa__agent_version',
    'yauaa__agent_version_major', 'yauaa__device_brand', 'yauaa__device_name',
    'yauaa__device_version', 'yauaa__layout_engine_class', 'yauaa__layout_engine_name',
    'yauaa__layout_engine_name_version', 'yauaa__layout_engine_name_version_major',
    'yauaa__layout_engine_version', 'yauaa__layout_engine_version_major',
    'yauaa__operating_system_class', 'yauaa__operating_system_name',
    'yauaa__operating_system_name_version', 'yauaa__operating_system_version',
    'ua__useragent_family', 'ua__useragent_major', 'ua__useragent_minor',
    'ua__useragent_patch', 'ua__useragent_version', 'ua__os_family', 'ua__os_major',
    'ua__os_minor', 'ua__os_patch', 'ua__os_patch_minor', 'ua__os_version',
    'ua__device_family', 'first_screen_view__name', 'first_screen_view__type',
    'last_screen_view__name', 'last_screen_view__transition_type', 'last_screen_view__type',
    'screen_view__previous_id', 'screen_view__previous_name', 'screen_view__previous_type',
    'first_geo__latitude', 'first_geo__longitude', 'first_geo__latitude_longitude_accuracy',
    'first_geo__altitude', 'first_geo__altitude_accuracy', 'first_geo__bearing',
    'first_geo__speed', 'screen__fragment', 'screen__top_view_controller',
    'screen__view_controller', 'useragent', 'event_id',
)

USERS_AGGS_COLUMNS = (
    'user_identifier', 'start_tstamp', 'end_tstamp', 'first_session_identifier',
    'last_session_identifier', 'views', 'sessions', 'active_days', 'engaged_time_in_s',
    'absolute_time_in_s',
)

USERS_LASTS_COLUMNS = (
    'user_identifier', 'last_platform', 'last_os_type', 'last_os_version',
    'last_screen_resolution', 'last_geo_country', 'last_geo_country_name',
    'last_geo_continent', 'last_geo_city', 'last_geo_region_name', 'last_page_url',
    'last_page_title', 'last_page_urlscheme', 'last_page_urlhost', 'last_page_urlpath',
    'last_page_urlquery', 'last_page_urlfragment', 'last_br_lang', 'last_br_lang_name',
    'last_screen_view__name', 'last_screen_view__transition_type', 'last_screen_view__type',
    'last_mobile__carrier', 'last_mobile__device_manufacturer', 'last_mobile__device_model',
    'last_event_id',
)

USERS_COLUMNS = (
    'user_id', 'user_identifier', 'network_userid', 'stitched_user_id', 'start_tstamp',
    'end_tstamp', 'model_tstamp', 'first_platform', 'last_platform', 'on_web', 'on_mobile',
    'last_screen_resolution', 'last_os_type', 'last_os_version',
    'first_mobile__device_manufacturer', 'first_mobile__device_model',
    'first_mobile__carrier', 'last_mobile__device_manufacturer',
    'last_mobile__device_model', 'last_mobile__carrier', 'mobile__os_type',
    'mobile__os_version', 'mobile__android_idfa', 'mobile__apple_idfa',
    'mobile__apple_idfv', 'mobile__open_idfa', 'mobile__network_technology',
    'mobile__network_type', 'mobile__physical_memory', 'mobile__system_available_memory',
    'mobile__app_available_memory', 'mobile__battery_level', 'mobile__battery_state',
    'mobile__low_power_mode', 'mobile__available_storage', 'mobile__total_storage',
    'mobile__is_portrait', 'mobile__resolution', 'mobile__scale', 'mobile__language',
    'mobile__app_set_id', 'mobile__app_set_id_scope', 'mobile_language_name',
    'first_geo_country', 'first_geo_country_name', 'first_geo_continent', 'first_geo_city',
    'first_geo_region_name', 'last_geo_country', 'last_geo_country_name',
    'last_geo_continent', 'last_geo_city', 'last_geo_region_name', 'geo_zipcode',
    'geo_latitude', 'geo_longitude', 'geo_timezone', 'views', 'sessions', 'active_days',
    'engaged_time_in_s', 'absolute_time_in_s', 'page_referrer', 'refr_medium',
    'refr_source', 'refr_term', 'first_page_title', 'first_page_url',
    'first_page_urlscheme', 'first_page_urlhost', 'first_page_urlpath',
    'first_page_urlquery', 'first_page_urlfragment', 'first_br_lang', 'first_br_lang_name',
    'last_page_title', 'last_page_url', 'last_page_urlscheme', 'last_page_urlhost',
    'last_page_urlpath', 'last_page_urlquery', 'last_page_urlfragment', 'last_br_lang',
    'last_br_lang_name', 'refr_urlscheme', 'refr_urlhost', 'refr_urlpath', 'refr_urlquery',
    'refr_urlfragment', 'first_screen_view__name', 'first_screen_view__type',
    'last_screen_view__name', 'last_screen_view__transition_type', 'last_screen_view__type',
    'mkt_medium', 'mkt_source', 'mkt_term', 'mkt_content', 'mkt_campaign', 'mkt_clickid',
    'mkt_network', 'mkt_source_platform', 'default_channel_group', 'first_event_id',
    'last_event_id',
)

PV_ENGAGED_COLUMNS = (
    'view_id', 'session_identifier', 'end_tstamp', 'engaged_time_in_s', 'absolute_time_in_s',
)

PV_SCROLL_COLUMNS = (
    'view_id', 'session_identifier', 'doc_width', 'doc_height', 'br_viewwidth',
    'br_viewheight', 'hmin', 'hmax', 'vmin', 'vmax', 'relative_hmin', 'relative_hmax',
    'relative_vmin', 'relative_vmax', 'last_list_item_index', 'list_items_count',
    'list_items_percentage_scrolled',
)

SCREEN_SUMMARY_COLUMNS = (
    'view_id', 'session_identifier', 'foreground_sec', 'background_sec', 'last_item_index',
    'items_count', 'min_x_offset', 'min_y_offset', 'max_x_offset', 'max_y_offset',
    'content_width', 'content_height', 'horizontal_percentage_scrolled',
    'vertical_percentage_scrolled', 'list_items_percentage_scrolled',
)

ATOMIC_FIELDS = (
    'app_id', 'platform', 'etl_tstamp', 'collector_tstamp', 'dvce_created_tstamp', 'event',
    'event_id', 'txn_id', 'name_tracker', 'v_tracker', 'v_collector', 'v_etl',
    'user_id', 'user_ipaddress', 'user_fingerprint', 'domain_userid',
    'domain_sessionidx', 'network_userid', 'geo_country', 'geo_region', 'geo_city',
    'geo_zipcode', 'geo_latitude', 'geo_longitude', 'geo_region_name', 'ip_isp',
    'ip_organization', 'ip_domain', 'ip_netspeed', 'page_url', 'page_title',
    'page_referrer', 'page_urlscheme', 'page_urlhost', 'page_urlport', 'page_urlpath',
    'page_urlquery', 'page_urlfragment', 'refr_urlscheme', 'refr_urlhost',
    'refr_urlport', 'refr_urlpath', 'refr_urlquery', 'refr_urlfragment', 'refr_medium',
    'refr_source', 'refr_term', 'mkt_medium', 'mkt_source', 'mkt_term', 'mkt_content',
    'mkt_campaign', 'contexts', 'se_category', 'se_action', 'se_label', 'se_property',
    'se_value', 'unstruct_event', 'tr_orderid', 'tr_affiliation', 'tr_total',
    'tr_tax', 'tr_shipping', 'tr_city', 'tr_state', 'tr_country', 'ti_orderid',
    'ti_sku', 'ti_name', 'ti_category', 'ti_price', 'ti_quantity',
    'pp_xoffset_min', 'pp_xoffset_max', 'pp_yoffset_min', 'pp_yoffset_max',
    'useragent', 'br_name', 'br_family', 'br_version', 'br_type', 'br_renderengine',
    'br_lang', 'br_features_pdf', 'br_features_flash', 'br_features_java',
    'br_features_director', 'br_features_quicktime',
    'br_features_realplayer', 'br_features_windowsmedia',
    'br_features_gears', 'br_features_silverlight', 'br_cookies',
    'br_colordepth', 'br_viewwidth', 'br_viewheight', 'os_name', 'os_family',
    'os_manufacturer', 'os_timezone', 'dvce_type', 'dvce_ismobile',
    'dvce_screenwidth', 'dvce_screenheight', 'doc_charset', 'doc_width',
    'doc_height', 'tr_currency', 'tr_total_base', 'tr_tax_base',
    'tr_shipping_base', 'ti_currency', 'ti_price_base', 'base_currency',
    'geo_timezone', 'mkt_clickid', 'mkt_network', 'etl_tags', 'dvce_sent_tstamp',
    'refr_domain_userid', 'refr_dvce_tstamp', 'derived_contexts', 'domain_sessionid',
    'derived_tstamp', 'event_vendor', 'event_name', 'event_format', 'event_version',
    'event_fingerprint', 'true_tstamp',
)

# Type markers of the TSV fields: fields listed here are parsed as numbers,
# booleans or JSON documents; every other field is text.
NUMBER_FIELDS = (
    "txn_id", "domain_sessionidx", "geo_latitude", "geo_longitude", "page_urlport",
    "refr_urlport", "tr_total", "tr_tax", "tr_shipping", "ti_price", "ti_quantity",
    "pp_xoffset_min", "pp_xoffset_max", "pp_yoffset_min", "pp_yoffset_max",
    "br_viewwidth", "br_viewheight", "dvce_screenwidth", "dvce_screenheight",
    "doc_width", "doc_height", "tr_total_base", "tr_tax_base", "tr_shipping_base",
    "ti_price_base",
)
BOOL_FIELDS = (
    "br_features_pdf", "br_features_flash", "br_features_java", "br_features_director",
    "br_features_quicktime", "br_features_realplayer", "br_features_windowsmedia",
    "br_features_gears", "br_features_silverlight", "br_cookies", "dvce_ismobile",
)
JSON_FIELDS = ("contexts", "unstruct_event", "derived_contexts")
TIMESTAMP_FIELDS = (
    "etl_tstamp", "collector_tstamp", "dvce_created_tstamp", "dvce_sent_tstamp",
    "refr_dvce_tstamp", "derived_tstamp", "true_tstamp",
)

# --- FIXED VALUES: entity catalog -------------------------------------------
# prefix -> (source column(s), fields).  Context columns are arrays of structs
# (the first element is read), the screen_view event body is a single struct.
ENTITY_CATALOG = {
    "page_view": (("contexts_com_snowplowanalytics_snowplow_web_page_1",), ("id",)),
    "iab": (("contexts_com_iab_snowplow_spiders_and_robots_1",),
            ("category", "primary_impact", "reason", "spider_or_robot")),
    "ua": (("contexts_com_snowplowanalytics_snowplow_ua_parser_context_1",),
           ("useragent_family", "useragent_major", "useragent_minor", "useragent_patch",
            "useragent_version", "os_family", "os_major", "os_minor", "os_patch",
            "os_patch_minor", "os_version", "device_family")),
    "yauaa": (("contexts_nl_basjes_yauaa_context_1",),
              ("device_class", "agent_class", "agent_name", "agent_name_version",
               "agent_name_version_major", "agent_version", "agent_version_major",
               "device_brand", "device_name", "device_version", "layout_engine_class",
               "layout_engine_name", "layout_engine_name_version",
               "layout_engine_name_version_major", "layout_engine_version",
               "layout_engine_version_major", "operating_system_class",
               "operating_system_name", "operating_system_name_version",
               "operating_system_version")),
    "browser": (("contexts_com_snowplowanalytics_snowplow_browser_context_1",
                 "contexts_com_snowplowanalytics_snowplow_browser_context_2"),
                ("viewport", "document_size", "resolution", "color_depth",
                 "device_pixel_ratio", "cookies_enabled", "online", "browser_language",
                 "document_language", "webdriver", "device_memory", "hardware_concurrency",
                 "tab_id")),
    "screen_view": (("unstruct_event_com_snowplowanalytics_mobile_screen_view_1",),
                    ("id", "name", "previous_id", "previous_name", "previous_type",
                     "transition_type", "type")),
    "session": (("contexts_com_snowplowanalytics_snowplow_client_session_1",),
                ("session_id", "session_index", "previous_session_id", "user_id",
                 "first_event_id", "event_index", "storage_mechanism",
                 "first_event_timestamp")),
    "mobile": (("contexts_com_snowplowanalytics_snowplow_mobile_context_1",),
               ("device_manufacturer", "device_model", "os_type", "os_version",
                "android_idfa", "apple_idfa", "apple_idfv", "carrier", "open_idfa",
                "network_technology", "network_type", "physical_memory",
                "system_available_memory", "app_available_memory", "battery_level",
                "battery_state", "low_power_mode", "available_storage", "total_storage",
                "is_portrait", "resolution", "scale", "language", "app_set_id",
                "app_set_id_scope")),
    "geo": (("contexts_com_snowplowanalytics_snowplow_geolocation_context_1",),
            ("latitude", "longitude", "latitude_longitude_accuracy", "altitude",
             "altitude_accuracy", "bearing", "speed")),
    "app": (("contexts_com_snowplowanalytics_mobile_application_1",), ("build", "version")),
    "screen": (("contexts_com_snowplowanalytics_mobile_screen_1",),
               ("id", "name", "activity", "fragment", "top_view_controller", "type",
                "view_controller")),
    "deep_link": (("contexts_com_snowplowanalytics_mobile_deep_link_1",), ("url", "referrer")),
    "screen_summary": (("contexts_com_snowplowanalytics_mobile_screen_summary_1",),
                       ("foreground_sec", "background_sec", "last_item_index", "items_count",
                        "min_x_offset", "min_y_offset", "max_x_offset", "max_y_offset",
                        "content_width", "content_height")),
}

# Feature flag of each entity prefix (the mobile flag also gates the screen_view body).
ENTITY_FLAGS = {
    "page_view": "enable_web_page", "iab": "enable_iab", "ua": "enable_ua",
    "yauaa": "enable_yauaa", "browser": "enable_browser_context", "screen_view": "enable_mobile_context",
    "session": "enable_client_session_context", "mobile": "enable_mobile_context",
    "geo": "enable_geolocation_context", "app": "enable_application_context",
    "screen": "enable_screen_context", "deep_link": "enable_deep_link_context",
    "screen_summary": "enable_screen_summary_context",
}

# Entity fields that are not text.
ENTITY_FIELD_TYPES = {"iab__spider_or_robot": "boolean", "browser__color_depth": "int"}


def entity_columns():
    """All ``prefix__field`` names of the catalog, in catalog order."""
    return [f"{p}__{f}" for p, (_, fields) in ENTITY_CATALOG.items() for f in fields]


def atomic_type(name):
    """Spark SQL type name of an atomic TSV field."""
    if name in NUMBER_FIELDS:
        return "double"
    if name in BOOL_FIELDS:
        return "boolean"
    return "string"
