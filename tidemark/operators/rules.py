"""The rules of the text classifier and the groups of labels that rules alone cannot tell apart."""

from __future__ import annotations

# Words of water, one of which makes a movement of masses a wet one.
WET = [
    "rain", "rainfall", "water", "wet", "flood", "saturated", "runoff", "storm", "monsoon", "downpour", "moisture", "typhoon", "tropical",
]

# Triggers, label, and words of which one must be there as well (none: always), in their order.
RULES: list[tuple[list[str], str, list[str]]] = [
    (["tsunami"], "Tsunami", []),
    (["flash flood", "flashflood", "flash floods"], "FlashFlood", []),
    (["coastal flood", "coastal inundation", "tidal flood", "coastal", "sea water intrusion", "saltwater intrusion", "coastal surge"], "CoastalFlood", []),
    (["riverine flood", "river overflow", "overflowing river", "swollen river", "overflow", "riverine"], "RiverineFlood", []),
    (["ice jam"], "IceJamFlood", []),
    (["flood", "flooding", "inundation", "flooded"], "FloodGeneral", []),
    (["mudslide", "mudflow", "mud slide"], "Mudslide", []),
    (["landslide", "land slide"], "LandslideWet", WET),
    (["landslide", "land slide"], "LandslideDry", []),
    (["rockfall", "rock fall", "boulder", "rockslide"], "RockfallWet", WET),
    (["rockfall", "rock fall", "boulder", "rockslide"], "RockfallDry", []),
    (["avalanche (dry)", "dry avalanche"], "AvalancheDry", []),
    (["avalanche"], "AvalancheWet", WET),
    (["avalanche"], "AvalancheDry", []),
    (["subsidence"], "SuddenSubsidenceWet", WET),
    (["subsidence", "sinkhole", "liquefaction"], "SuddenSubsidenceDry", []),
    (["rogue wave", "rogue"], "RogueWave", []),
    (["seiche"], "Seiche", []),
    (["big waves", "large waves", "big wave"], "WaveActionGeneral", []),
    (["vehicular accident", "road accident", "road crash", "road collision", "collision"], "Road", []),
    (["boat sinking", "capsized", "motorbanca", "maritime accident", "ferry accident", "vessel accident", "maritime incident"], "Water", []),
    (["plane crash", "aircraft accident", "aviation accident", "plane", "airplane", "aircraft"], "Air", []),
    (["train accident", "rail accident", "derailment"], "Rail", []),
    (["drowning", "firework", "miscellaneous accident", "observance", "holiday", "election", "boga", "firecracker", "celebration", "year-end"], "MiscellaneousAccidentGeneral", []),
    (["armed conflict", "armed encounter", "shooting", "ambush", "gunfire", "gun fire", "gun battle", "disorganization"], "ArmedConflict", []),
    (["explosion", "bomb", "grenade", "blast"], "ExplosionIndustrial", []),
    (["explosion", "bomb", "grenade", "blast"], "ExplosionMiscellaneous", []),
    (["fire", "industrial fire", "factory fire", "warehouse fire"], "FireIndustrial", []),
    (["fire", "blaze", "conflagration"], "FireMiscellaneous", []),
    (["industrial collapse", "bridge collapse", "tower collapse"], "CollapseIndustrial", []),
    (["building collapse", "structure collapse", "collapse", "demolition", "fallen tree", "fallen debris", "uprooted", "fallen"], "CollapseMiscellaneous", []),
    (["oil spill", "oilspill", "oil leak"], "OilSpill", []),
    (["chemical spill", "hazmat", "chemical leak"], "ChemicalSpill", []),
    (["gas leak", "lpg leak"], "GasLeak", []),
    (["radiation", "nuclear"], "Radiation", []),
    (["poisoning", "food poisoning", "contamination"], "Poisoning", []),
    (["industrial accident"], "IndustrialAccidentGeneral", []),
    (["earthquake", "aftershock", "tremor", "seismic"], "GroundMovement", []),
    (["pyroclastic"], "PyroclasticFlow", []),
    (["lava flow", "lava"], "LavaFlow", []),
    (["lahar"], "Lahar", []),
    (["ashfall", "ash fall", "ash cloud"], "Ashfall", []),
    (["volcanic", "eruption", "volcano"], "VolcanicActivityGeneral", []),
    (["storm surge"], "StormSurge", []),
    (["tornado", "waterspout", "whirlwind"], "Tornado", []),
    (["thunderstorm", "lightning", "thunder"], "Thunderstorms", []),
    (["monsoon", "habagat", "amihan", "shear line", "low pressure area", "LPA", "SWM"], "StormGeneral", []),
    (["typhoon", "tropical storm", "tropical cyclone", "tropical depression", "super typhoon", "landfall"], "TropicalCyclone", []),
    (["strong wind", "severe weather", "gale", "squall", "continuous"], "SevereWeather", []),
    (["hail", "hailstorm"], "Hail", []),
    (["sand storm", "sandstorm", "dust storm"], "SandStorm", []),
    (["blizzard"], "BlizzardStorm", []),
    (["derecho"], "Derecho", []),
    (["extratropical storm", "extra-tropical storm", "frontal system", "front"], "ExtratropicalStorm", []),
    (["heat wave", "heat stroke", "extreme heat"], "HeatWave", []),
    (["cold wave", "cold spell", "cold snap"], "ColdWave", []),
    (["severe winter", "snowstorm", "freezing rain"], "SevereWinterConditions", []),
    (["fog"], "Fog", []),
    (["drought", "dry spell", "el nino"], "Drought", []),
    (["glacial lake outburst", "glacial"], "Glacial", []),
    (["forest fire"], "ForestFire", []),
    (["land fire", "grass fire", "grassfire", "brush fire"], "LandFire", []),
    (["wildfire", "bush fire", "wild fire"], "WildfireGeneral", []),
    (["animal attack", "snake bite", "dog bite"], "AnimalAccident", []),
    (["cholera", "salmonella", "bacterial disease"], "BacterialDisease", []),
    (["dengue", "covid", "influenza", "flu", "viral disease", "rabies"], "ViralDisease", []),
    (["malaria", "parasitic disease"], "ParasiticDisease", []),
    (["fungal disease", "fungal infection"], "FungalDisase", []),
    (["prion disease"], "PrionDisease", []),
    (["epidemic", "disease outbreak", "infectious disease"], "InfectiousDiseaseGeneral", []),
    (["locust"], "LocustInfestation", []),
    (["grasshopper"], "GrasshopperInfestation", []),
    (["worm infestation", "worms infestation", "worms"], "WormsInfestation", []),
    (["infestation", "pest infestation", "red tide", "pest"], "InfestationGeneral", []),
    (["meteorite", "asteroid", "space impact"], "SpaceImpact", []),
    (["geomagnetic storm", "solar flare", "space weather"], "SpaceWeather", []),
]

# Groups of labels that are left to a model where several of them fire.
GROUPS: list[set[str]] = [
    {"LandslideWet", "LandslideDry"},
    {"RockfallWet", "RockfallDry"},
    {"AvalancheWet", "AvalancheDry"},
    {"SuddenSubsidenceWet", "SuddenSubsidenceDry"},
    {"FireIndustrial", "FireMiscellaneous", "ForestFire", "LandFire", "WildfireGeneral"},
    {"ExplosionIndustrial", "ExplosionMiscellaneous"},
    {"CollapseIndustrial", "CollapseMiscellaneous"},
]
