"""Country sets. Fixed values."""

HELD_OUT = (
    "belgium", "cambodia", "croatia", "germany", "kenya", "latvia", "lithuania", "portugal", "slovenia", "south_africa", "sweden",
)
#: Labels there mark some fields only, and land without label is not background.
PRESENCE_ONLY = ("kenya",)
FULL = (
    "austria", "belgium", "brazil", "cambodia", "corsica", "croatia", "denmark", "estonia", "finland", "france", "germany", "latvia",
    "lithuania", "luxembourg", "netherlands", "portugal", "rwanda", "slovakia", "slovenia", "south_africa", "spain", "sweden", "vietnam",
)


#: Splits whose macro averages are reported: held-out countries whose background can be trusted, and all trained on.
SPLITS = {"dense10": tuple(sorted(set(HELD_OUT) - set(PRESENCE_ONLY))), "full23": FULL}
