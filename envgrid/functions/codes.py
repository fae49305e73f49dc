"""Species parameters and code lists."""

from __future__ import annotations

#: species, host, oak_lo, oak_hi, season a b c d (days of the year), cool nights none_at full_at (C), window (days), sm_lo, sm_hi, rain_lo, rain_hi (mm), lag_days
SPECIES = (
    ("chanterelle", "oak", 0.12, 0.30, 166, 186, 243, 268, None, None, 21, 0.20, 0.45, 25.0, 60.0, 7),
    ("black_trumpet", "oak", 0.12, 0.30, 182, 205, 262, 283, None, None, 21, 0.22, 0.48, 28.0, 65.0, 8),
    ("bolete", "oak_or_conifer", 0.12, 0.30, 161, 182, 273, 293, None, None, 14, 0.18, 0.40, 20.0, 50.0, 4),
    ("chicken", "oak", 0.08, 0.25, 152, 222, 283, 309, None, None, 21, 0.12, 0.35, 15.0, 45.0, 3),
    ("hen", "oak", 0.20, 0.40, 244, 269, 298, 314, 18.0, 13.0, 21, 0.15, 0.38, 20.0, 50.0, 7),
)
SPECIES_SCHEMA = "species string, host_kind string, oak_lo double, oak_hi double, a int, b int, c int, d int, none_at double, full_at double, win int, sm_lo double, sm_hi double, rain_lo double, rain_hi double, lag_days int"

#: Soil drainage classes, dry to wet.
DRAINAGE = {
    "Excessively drained": 1,
    "Somewhat excessively drained": 2,
    "Well drained": 3,
    "Moderately well drained": 4,
    "Somewhat poorly drained": 5,
    "Poorly drained": 6,
    "Very poorly drained": 7,
}

#: Forest type group codes.
FOREST_TYPE_GROUPS = {
    0: "Non-forest", 100: "White/red/jack pine", 120: "Spruce/fir", 140: "Longleaf/slash pine", 160: "Loblolly/shortleaf pine", 180: "Other eastern softwoods",
    200: "Douglas-fir", 220: "Ponderosa pine", 240: "Western white pine", 260: "Fir/spruce/mtn hemlock", 280: "Lodgepole pine", 300: "Hemlock/Sitka spruce",
    320: "Western larch", 340: "Redwood", 360: "Other western softwoods", 370: "California mixed conifer", 380: "Exotic softwoods", 390: "Other softwoods",
    400: "Oak/pine", 500: "Oak/hickory", 600: "Oak/gum/cypress", 700: "Elm/ash/cottonwood", 800: "Maple/beech/birch", 900: "Aspen/birch", 910: "Alder/maple",
    920: "Western oak", 940: "Tanoak/laurel", 950: "Other hardwoods", 980: "Woodland hardwoods", 990: "Exotic hardwoods", 999: "Nonstocked",
}

#: LIKE patterns of public owners.
PUBLIC_OWNERS = [
    "TOWN OF%", "%TOWN OF", "CITY OF%", "%CITY OF", "COMMONWEALTH OF MASS%", "MASSACHUSETTS %", "MASS DEPT%", "MASS DIV%", "MASS DCR%", "%COUNTY OF%",
    "BARNSTABLE COUNTY%", "PLYMOUTH COUNTY%", "UNITED STATES%", "USA %", "USA", "%US ARMY%", "%US FISH%", "%US DEPT%", "%US GOVERNMENT%",
    "%NATIONAL PARK SERVICE%", "%HOUSING AUTHORITY%", "%WATER DISTRICT%", "%FIRE DISTRICT%", "%SCHOOL DISTRICT%", "%CONSERVATION COMMISSION%",
    "%REDEVELOPMENT AUTHORITY%",
]
