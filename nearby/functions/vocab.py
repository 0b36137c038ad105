"""Closed vocabularies and rule patterns of listings and places.

Fixed values: results are only right with exactly these words and patterns. Patterns are matched without
regard to case unless said otherwise; the order of a rule table is its priority.
"""

#: Event type and its pattern, most defining first.
TYPES = (
    ('scavenger hunt', '\\b(scavenger hunt|treasure hunt|geocach\\w*|photo hunt)\\b'),
    ('speed dating', '\\b(speed dating|singles (night|mixer|event)|matchmaking|blind date|date night mixer)\\b'),
    ('trivia', '\\b(trivia|pub quiz|quizzo|bingo)\\b'),
    ('open mic', '\\b(open[- ]mic|open mike)\\b'),
    ('open studio', '\\b(open studio\\w*|studio tour|maker\\w* space night)\\b'),
    ('q&a', '\\b(q\\s*&\\s*a|q and a|ask me anything|fireside chat|audience questions)\\b'),
    ('meet & greet', '\\b(meet[ &and]*greet|meet the (artist|author|maker|brewer)|book signing|autograph)\\b'),
    ('animal encounter', '\\b(petting zoo|animal (encounter|meet|feeding|ambassador)|raptor|falconry|reptile show|aquarium feeding|zoo ?(kids|babies|tots)|meet (the|our) (animals|raptors|reptiles|owls)|critter|creature feature|read to (a )?(dog|rover))\\b'),
    ('religious ceremony', '\\b(mass\\b|worship|(?:church|sunday|sabbath|candlelight|interfaith|healing)\\s+services?\\b|liturgy|vespers|evensong|shabbat|kiddush|jumu.?ah|puja|sangha|rosary|novena|communion|baptism|confirmation|sermon|prayer (service|meeting)|high holy days|yom kippur|rosh hashanah)\\b'),
    ('giveaway', '\\b(free (vegetable|produce|food|book|meal|lunch|dinner|grocer\\w*|clothing|coat|backpack|supplies|naloxone|narcan)|giveaway|give[- ]?away|food (pantry|distribution)|produce distribution|book cave|little free|distribution (day|event)|swap shop|really really free)\\b'),
    ('tabling', '\\b(tabling|mobile office|office hours|navigator|drop[- ]?in (tech|computer|legal|health|help)|(tech|computer|legal|homework|resume) help|enrollment assistance|sign[- ]?up (table|event)|information table|resource (table|fair)|assemblymember|state senator|councilmember)\\b'),
    ('yoga', '\\b(yoga|pilates|tai chi|qi ?gong|meditation|sound bath|breathwork|restorative|mindfulness)\\b'),
    ('workout', '\\b(workout|bootcamp|hiit|crossfit|spin class|zumba|strength (class|training)|fitness class|barre)\\b'),
    ('tasting', '\\b(tasting|flight night|cellar|sommelier|cupping|wine (dinner|pairing)|beer pairing)\\b'),
    ('breakfast', '\\b(breakfast|brunch|pancake|coffee hour|morning social)\\b'),
    ('lunch', '\\b(lunch(eon)?|midday meal)\\b'),
    ('dinner', '\\b(dinner|supper|bbq|barbecue|clambake|fish fry|pot ?luck|feast|banquet)\\b'),
    ('musical', '\\b(musicals?|operas?|operetta)\\b'),
    ('comedy show', '\\b(comedy|stand[- ]?up|improv|sketch show)\\b'),
    ('play', '\\b(theat(er|re)|cabaret|drag show|puppet show)\\b|\\b(?:a|the|new|one[- ]act) plays?\\b|\\bplay (?:by|reading)\\b'),
    ('film', '\\b(films?|movies?|screening|cinema|documentar\\w*|matinee)\\b'),
    ('dj', '\\b(dj\\b|turntabl\\w*|vinyl night|silent disco)\\b'),
    ('dance', '\\b(dance|ballet|salsa|swing|tango|contra|line dancing)\\b'),
    ('concert', '\\b(concert|live music|bands?|recital|symphony|orchestra|quartet|trio|songwriter|acoustic|jazz|blues|folk|choir|singer|tribute|residency|tour dates?)\\b'),
    ('party', '\\b(party|bash|afterparty|after[- ]party|nightlife|block party|mixer)\\b'),
    ('celebration', '\\b(celebration|anniversary|birthday|gala|jubilee|tree lighting|fireworks|opening day|ceremony)\\b'),
    ('festival', '\\b(festival|fest\\b|fair(?! (booth|trade))|carnival|jamboree)\\b'),
    ('parade', '\\bparade\\b'),
    ('protest', '\\b(rally|protest|demonstration|vigil|picket|walkout)\\b|\\bmarch(es|ing)? (for|on|against|to demand)\\b'),
    ('market', '\\b(market|bazaar|makers?\\b|vendors?|craft fair|swap meet)\\b'),
    ('sale', '\\b(sale|flea|rummage|tag sale|book sale|clearance)\\b'),
    ('volunteer', '\\b(volunteer|work ?day|stewardship|planting|fundraiser|benefit|(blood|food|coat|toy|book|clothing|donation|canned[- ]food) drive|give ?back|charity|clean[- ]?up day)\\b'),
    ('game', '\\b(game night|board ?games?|trading cards?|escape room|chess|mah ?jong?g?|bridge club|dungeons|karaoke|tabletop|video ?game|dominoes|cribbage|canasta)\\b'),
    ('sporting event', '\\b(basketball|soccer|volleyball|baseball|softball|hockey|lacrosse|tennis|golf|swimming|diving|cross country|field hockey|football|rugby|pickleball|race|5k|10k|marathon|tournament|martial arts|karate|taekwondo|jiu[- ]?jitsu|judo|boxing|regatta|derby)\\b'),
    ('art exhibit', '\\b(art (exhibit\\w*|show)|gallery|opening reception|installation|sculpture|paintings?|artist talk)\\b'),
    ('museum exhibit', '\\b(exhibit\\w*|on view|retrospective|showcase|permanent collection|special collection|museums?|planetarium|observatory|aquarium|zoo\\b|historic (house|site|home)|admission|general admission)\\b'),
    ('tour', '\\b(tours?|guided walk|house tour|behind the scenes|hike|hiking|walking tour|birding|paddle|kayak)\\b'),
    ('talk', '\\b(charla|conferencia|presentaci[oó]n|taller|programa de|consejos|c[oó]mo\\b|clase de)\\b|\\b(talk|lecture|reading|panel|author|poet|keynote|symposium|seminar|presentation|storytime|story time|planetarium|astronomy|book club)\\b'),
    ('craft', '\\b(knit\\w*|crochet|quilt\\w*|sewing|weaving|needlepoint|embroider\\w*|macram|pottery|ceramics?|kiln|collage|printmaking|linocut|calligraphy|woodworking|whittl\\w*|jewel\\w*[- ]making|scrapbook\\w*|papercraft|origami|make[- ]your[- ]own|make this|diy\\b|craft(?!\\ (beer|brew|cocktail|distiller|cider|fair|show)))\\b'),
    ('class', '\\b(workshops?|class(es)?|lessons?|courses?|clinic|training|demo|certification|certificate|bootcamp|intro to|101|paint[- ]?(and|n|&)[- ]?sip|watercolou?r\\w*)\\b'),
    ('club', '\\b(club\\b|society|guild|chapter meeting|circle\\b|meetup|town hall|forum|networking|gathering|support group|social hour)\\b'),
)

#: Words of the open air.
OUTDOOR = '\\b(outdoors?|outside|park|trail|garden|lawn|riverfront|field|farm|orchard|hike|hiking|paddle|kayak|beach|meadow|grounds|picnic|rain date|weather permitting|plaza|courtyard)\\b'
#: Words of a roof.
INDOOR = '\\b(theat(er|re)|gallery|library|museum|hall|studio|taproom|auditorium|ballroom|basement|indoors?|classroom|sanctuary|lounge)\\b'
#: Words of food and drink.
FOOD_WORDS = '\\b(dinner|tasting|brunch|supper|breakfast|lunch|bbq|barbecue|food trucks?|potluck|refreshments|snacks|concessions|cash bar|beer|wine|cider|cocktails?|coffee|dessert|pizza|oysters?|food (and|&) drink|catered)\\b'

#: Event type that a venue's name implies.
VENUE_TYPES = (
    ('comedy show', '\\b(comedy (club|cellar|works)|laugh (factory|lounge))\\b'),
    ('sporting event', '\\b(stadium|ball ?park|arena|speedway|racetrack|raceway|coliseum|ballfield|athletic (field|complex)|ice rink)\\b'),
    ('concert', '\\b(ballroom|music hall|amphitheat\\w*|bandshell|bowl\\b|lounge|tavern|jazz club|underground|sound ?stage|concert hall|fairgrounds?)\\b'),
    ('play', '\\b(theatres?|theaters?|playhouse|opera house)\\b'),
    ('museum exhibit', '\\b(museum|planetarium|observatory|aquarium|zoo)\\b'),
    ('film', '\\b(cinema|film center|drive[- ]in)\\b'),
    ('art exhibit', '\\b(gallery|art cent(er|re))\\b'),
)

#: Older, coarser categories.
LEGACY_CATEGORIES = (
    ('protest', '\\b(rally|protest|demonstration|vigil|picket|walkout)\\b|\\bmarch(es|ing)? (for|on|against|to demand)\\b'),
    ('parade', '\\bparade\\b'),
    ('comedy', '\\b(comedy|stand-?up|improv)\\b'),
    ('film', '\\b(film|movie|screening|cinema|documentar)\\w*'),
    ('music', '\\b(concert|band|jazz|live music|songwriter|acoustic|orchestra|symphony|choir|blues|folk|open mic|dj|recital|quartet|trio)\\b'),
    ('show', '\\b(theat(er|re)|play|musical|performance|drag|cabaret|opera|dance|circus)\\b'),
    ('art', '\\b(art|gallery|exhibition|opening reception|painting|sculpture|artist|ceramic|photograph)\\w*'),
    ('market', '\\b(market|fair|festival|bazaar|vendors?|craft show)\\b'),
    ('sale', '\\b(sale|flea|rummage|tag sale|book sale|swap)\\b'),
    ('tour', '\\b(tour|guided walk|house tour|behind the scenes)\\b'),
    ('outdoors', '\\b(hike|hiking|walk|paddle|kayak|canoe|bird|trail|garden|nature|cleanup|forest|river|outdoor)\\w*'),
    ('family', '\\b(kids?|child(ren)?|family|storytime|story time|toddler|teen|youth)\\b'),
    ('class', '\\b(workshop|class|lesson|course|seminar|clinic|training|demo|lecture|talk|reading)\\b'),
    ('food', '\\b(dinner|tasting|brunch|food|wine|beer|cider|potluck|supper|bbq|barbecue|breakfast|lunch)\\b'),
    ('sports', '\\b(yoga|run|race|5k|10k|fitness|pickleball|hockey|baseball|soccer|tournament|golf)\\b'),
    ('community', '\\b(meeting|forum|town hall|volunteer|community|fundraiser|benefit|social|meetup|club)\\b'),
    ('nightlife', '\\b(bar|party|nightlife|late night|after ?party)\\b'),
)

#: Words of something that goes on.
ACTIVITY_HINTS = '\\b(every|weekly|monthly|daily|ongoing|drop-?in|series|recurring|each (mon|tues|wednes|thurs|fri|satur|sun)day|open hours)\\b'
#: Children only.
KIDS_ONLY = '\\b(grades?\\s*(k|pre-?k|\\d{1,2})|ages?\\s*(?:[0-9]|1[0-8])\\s*(?:[-–—]|to)\\s*(?:[0-9]|1[0-8])\\b|(?:kids|children)\\s+ages?\\s*\\d|ages?\\s*[0-9]\\s*(?:and|&)\\s*(?:up|older|over)|children entering|toddlers?|pre-?school|storytime|story time|kids only|teens?|for kids|children only|youth (program|group|club)|drop-?off program|campers?)\\b'
#: Aimed at families with children.
CHILD_FOCUSED = "\\b(children'?s?|child|kids?|kiddos|toddlers?|preschool|pre-?k|storytime|story time|story hour|puppet|pajama|youth|teens?|tweens?|bab(y|ies)(?! boomer)|infants?|family (day|fun|night|program|workshop|storytime|festival|film|movie|concert)|for families|children & families|all[- ]ages drop[- ]in|petting zoo|face painting|bounce house|trick[- ]or[- ]treat|lego|craft (time|hour)|summer reading)\\b"
#: Names children.
FOR_CHILDREN = "\\b(children'?s?|kids?|family|families|youth|toddlers?|storytime)\\b"
#: Aimed at older adults.
SENIORS = '(?<!\\w)(?:55|60|62|65)\\s*\\+(?!\\w)|\\b(?:older adults?|senior citizens?|for seniors|seniors only|seniors welcome|(?:55|60|62|65) and (?:up|over|older)|senior (?:breakfast|lunch(?:eon)?|social|club|bingo|movie|matinee|fitness|yoga|stretch|chair|tech|hour|day|center|centre|swim|walk|exercise))\\b'
#: A match between two sides.
FIXTURE = '\\bvs\\.?(?:\\s|$)'
#: A price and what it is for.
PRICE_CLAUSE = '\\$\\s*\\d+(?:\\.\\d{2})?[^.|;\\n]{0,60}'
#: Adults only.
ADULTS_ONLY = '(?<!\\w)(21\\s*\\+|18\\s*\\+|21 and over|18 and over|adults? only|must be 21|ages 21|over 21|21 years|21 and up|no minors)(?!\\w)'
#: A street address.
STREET_ONLY = "^\\s*\\d+[-\\d]*\\s+[\\w.'\\- ]+?\\s*(st|street|rd|road|ave|avenue|blvd|boulevard|ln|lane|dr|drive|way|pl|place|ct|court|hwy|highway|tpke|turnpike|pkwy|parkway|route|rt|sq|square)\\.?\\s*$"

#: Names of platforms and placeholders.
NOT_A_PLACE = (
    'eventbrite', 'meetup', 'online', 'see listing', 'songkick', 'tba', 'tbd', 'ticketmaster', 'various', 'various locations',
)
#: Words that stay small in a name.
SMALL_WORDS = (
    'a', 'an', 'and', 'at', 'for', 'in', 'of', 'on', 'the',
)

#: Place kind and label, in display order.
PLACE_KINDS = (
    ('museum', 'Museums'),
    ('gallery', 'Galleries & studios'),
    ('historic house', 'Historic houses & mansions'),
    ('castle', 'Castles'),
    ('historic site', 'Historic sites'),
    ('garden', 'Gardens & arboretums'),
    ('park', 'Parks & nature'),
    ('lookout', 'Lookouts & towers'),
    ('landmark', 'Landmarks & monuments'),
    ('zoo', 'Zoos & aquariums'),
    ('theme park', 'Theme & water parks'),
    ('winery', 'Wineries & vineyards'),
    ('brewery', 'Breweries & distilleries'),
    ('farm', 'Farms & orchards'),
    ('theatre', 'Theatres'),
    ('cinema', 'Cinemas'),
    ('music venue', 'Music venues'),
    ('stadium', 'Stadiums & arenas'),
    ('bowling alley', 'Bowling alleys'),
    ('library', 'Libraries'),
    ('bookshop', 'Book shops'),
    ('antique shop', 'Antique shops'),
    ('mall', 'Malls & markets'),
    ('shop', 'Specialty shops'),
    ('cafe', 'Cafés'),
    ('restaurant', 'Restaurants & bars'),
    ('community centre', 'Community centres'),
    ('place of worship', 'Places of worship'),
    ('school', 'Schools & colleges'),
    ('club', 'Clubs & halls'),
)
#: Kinds worth a trip.
DESTINATIONS = (
    'museum', 'gallery', 'historic house', 'castle', 'historic site', 'garden', 'park', 'lookout', 'landmark', 'zoo', 'theme park', 'winery',
    'brewery', 'farm', 'theatre', 'cinema', 'music venue', 'stadium', 'bowling alley', 'library', 'bookshop', 'antique shop', 'mall', 'shop',
    'cafe', 'restaurant',
)
#: Kinds that serve food.
FOOD_KINDS = (
    'cafe', 'restaurant',
)

#: Place kind and its tag selectors: presence, equality or pattern.
TAG_RULES = (
    ('museum', ('"tourism"="museum"', '"historic"="museum"', '"amenity"="planetarium"')),
    ('gallery', ('"tourism"="gallery"', '"shop"="art"')),
    ('historic house', ('"historic"="manor"', '"historic"="villa"', '"building"="manor"', '"historic"="house"')),
    ('castle', ('"historic"="castle"', '"building"="castle"')),
    ('historic site', ('"historic"~"^(monument|memorial|ruins|archaeological_site|battlefield|fort|city_gate|aqueduct|tomb|mine|heritage|lighthouse|locomotive|ship|wreck)$"', '"tourism"="historic"', '"heritage"', '"man_made"="lighthouse"')),
    ('garden', ('"leisure"="garden"', '"garden:type"="botanical"', '"tourism"="botanical_garden"', '"leisure"="arboretum"')),
    ('park', ('"leisure"="nature_reserve"', '"leisure"="park"', '"boundary"="protected_area"')),
    ('zoo', ('"tourism"="zoo"', '"tourism"="aquarium"')),
    ('theme park', ('"tourism"="theme_park"', '"leisure"="water_park"')),
    ('lookout', ('"tourism"="viewpoint"', '"man_made"="tower"')),
    ('landmark', ('"tourism"="attraction"', '"natural"="arch"')),
    ('winery', ('"craft"="winery"', '"amenity"="winery"', '"tourism"="wine_cellar"', '"landuse"="vineyard"')),
    ('brewery', ('"craft"~"^(brewery|distillery|cidery)$"', '"microbrewery"="yes"', '"amenity"="biergarten"')),
    ('farm', ('"shop"="farm"', '"tourism"="farm"')),
    ('theatre', ('"amenity"="theatre"', '"amenity"="arts_centre"')),
    ('cinema', ('"amenity"="cinema"',)),
    ('music venue', ('"amenity"="music_venue"', '"amenity"="nightclub"')),
    ('stadium', ('"leisure"="stadium"', '"leisure"="ice_rink"')),
    ('bowling alley', ('"leisure"="bowling_alley"',)),
    ('library', ('"amenity"="library"',)),
    ('bookshop', ('"shop"="books"',)),
    ('antique shop', ('"shop"="antiques"',)),
    ('mall', ('"shop"="mall"', '"amenity"="marketplace"')),
    ('shop', ('"shop"="gift"', '"shop"="craft"', '"shop"="art"', '"shop"="music"', '"shop"="musical_instrument"', '"shop"="second_hand"', '"shop"="charity"', '"shop"="garden_centre"', '"shop"="pottery"', '"shop"="chocolate"', '"shop"="cheese"', '"shop"="tea"', '"shop"="games"', '"shop"="collector"', '"shop"="comics"', '"shop"="record"', '"shop"="fabric"')),
    ('cafe', ('"amenity"="cafe"', '"amenity"="ice_cream"', '"shop"="bakery"', '"shop"="coffee"', '"shop"="pastry"')),
    ('restaurant', ('"amenity"="restaurant"', '"amenity"="fast_food"', '"amenity"="pub"', '"amenity"="bar"', '"amenity"="food_court"')),
    ('community centre', ()),
    ('place of worship', ()),
    ('school', ()),
    ('club', ()),
)

#: Place kind that a name says, first match.
NAME_RULES = (
    ('museum', '\\b(museum|planetarium|historical societ(y|ies))\\b'),
    ('castle', '\\bcastle\\b'),
    ('historic house', '\\b(mansion|manor|homestead|estate|house museum|historic (house|home|site)|birthplace)\\b'),
    ('historic site', '\\b(battlefield|monument|memorial|fort\\b|ruins|lighthouse|heritage (site|cent(er|re)))\\b'),
    ('garden', '\\b(botanical|arboretum|conservatory|gardens?)\\b'),
    ('cinema', '\\b(cinema|drive-?in|film cent(er|re)|movie ?house|picture house|screening room)\\b'),
    ('theatre', '\\b(theat(er|re)|playhouse|opera house)\\b'),
    ('music venue', '\\b(ballroom|music hall|amphitheat\\w*|bandshell|bowl\\b|lounge|jazz club|concert hall|sound ?stage|performing arts|arts cent(er|re))\\b'),
    ('bowling alley', '\\b(bowl(ing)?\\s*(alley|lanes?|centre|center)|lanes\\b|bowlero)\\b'),
    ('zoo', '\\b(zoo\\b|aquarium|safari park|wildlife cent(er|re))\\b'),
    ('theme park', '\\b(theme park|amusement park|water ?park|fun ?plex|playland)\\b'),
    ('lookout', '\\b(overlook|lookout|fire tower|observation (tower|deck)|watchtower|scenic (vista|view))\\b'),
    ('stadium', '\\b(stadium|ball ?park|arena|speedway|racetrack|raceway|coliseum|ballfield|fairgrounds?|ice rink)\\b'),
    ('gallery', '\\b(galler(y|ies)|art cent(er|re)|studios?)\\b'),
    ('winery', '\\b(winer\\w*|vineyards?|meader\\w*|wine cellar)\\b'),
    ('brewery', '\\b(brew\\w*|taproom|tap house|beer (garden|hall)|cider\\w*|distiller\\w*)\\b'),
    ('farm', '\\b(farm\\b|farmstead|orchard|creamery|apiary|pick[- ]your[- ]own|cider mill)\\b'),
    ('library', '\\b(librar(y|ies)|reading room|athenaeum)\\b'),
    ('bookshop', '\\b(book ?(shop|store|s\\b)|booksellers?|bindery)\\b'),
    ('antique shop', '\\b(antiques?|vintage|salvage|flea market)\\b'),
    ('mall', '\\b(mall\\b|shopping cent(er|re)|galleria|marketplace|farmers.? market|market\\b)\\b'),
    ('park', '\\b(park|preserve|sanctuary|trail|nature cent(er|re)|conservation|lake|beach|woods|state forest)\\b'),
    ('cafe', '\\b(caf[eé]|coffee|espresso|roaster\\w*|tea (room|shop|house)|bakery|patisserie|gelato|java)\\b'),
    ('restaurant', '\\b(restaurant|kitchen|bistro|trattoria|osteria|tavern|grill(e|house)?|diner|eatery|pizzeria|steakhouse|bar\\ ?&|pub\\b|saloon)\\b'),
    ('community centre', '\\b(community cent(er|re)|civic cent(er|re)|rec(reation)? cent(er|re)|senior cent(er|re)|ymca|ywca|jcc\\b|grange|american legion|elks|rotary|town hall|village hall|city of\\b|town of\\b|firehouse|fire (department|company))\\b'),
    ('school', '\\b(school|college|universit(y|ies)|academy|institute|campus)\\b'),
    ('place of worship', '\\b(church|temple|synagogue|chapel|cathedral|mosque|meeting ?house|congregation|parish|sangha|monastery)\\b'),
    ('shop', '\\b(shop|store|boutique|emporium)\\b'),
    ('club', '\\b(club|society|lodge|guild|hall\\b)\\b'),
)

#: Cuisine group and label, in display order.
CUISINES = (
    ('seafood', 'Seafood'),
    ('american', 'American'),
    ('pizza', 'Pizza'),
    ('italian', 'Italian'),
    ('burger', 'Burgers'),
    ('sandwich', 'Sandwiches & delis'),
    ('breakfast', 'Breakfast & brunch'),
    ('diner', 'Diners'),
    ('bakery', 'Bakeries & donuts'),
    ('coffee', 'Coffee, tea & juice'),
    ('dessert', 'Ice cream & desserts'),
    ('mexican', 'Mexican & Latin American'),
    ('chinese', 'Chinese'),
    ('japanese', 'Japanese & sushi'),
    ('thai', 'Thai'),
    ('korean', 'Korean'),
    ('vietnamese', 'Vietnamese'),
    ('indian', 'Indian'),
    ('asian', 'Other Asian'),
    ('mediterranean', 'Mediterranean & Middle Eastern'),
    ('french', 'French'),
    ('barbecue', 'Barbecue'),
    ('steak', 'Steakhouses'),
    ('chicken', 'Chicken & wings'),
    ('salad', 'Salads & bowls'),
    ('vegetarian', 'Vegetarian & vegan'),
    ('pub', 'Pub food'),
)

#: Cuisine group and the tokens that mean it.
CUISINE_TOKENS = {
    'seafood': ('seafood', 'fish', 'fish_and_chips', 'lobster', 'oyster', 'oysters', 'clam', 'clams', 'crab', 'shellfish', 'chowder', 'sushi_and_seafood'),
    'american': ('american', 'new_american', 'american;burger', 'comfort_food', 'southern', 'soul_food', 'cajun', 'creole', 'bbq_and_american'),
    'pizza': ('pizza', 'italian_pizza', 'pizza_and_pasta', 'neapolitan_pizza', 'pizzeria'),
    'italian': ('italian', 'pasta', 'sicilian', 'tuscan', 'trattoria'),
    'burger': ('burger', 'burgers', 'hamburger', 'hot_dog', 'hotdog', 'hot_dogs', 'cheeseburger'),
    'sandwich': ('sandwich', 'sandwiches', 'deli', 'delicatessen', 'sub', 'subs', 'submarine', 'cheesesteak', 'wrap', 'panini', 'hoagie', 'roast_beef'),
    'breakfast': ('breakfast', 'brunch', 'pancake', 'pancakes', 'waffle', 'eggs', 'breakfast_and_lunch'),
    'diner': ('diner', 'american_diner'),
    'bakery': ('bakery', 'pastry', 'pastries', 'donut', 'donuts', 'doughnut', 'bagel', 'bagels', 'croissant', 'cake', 'cupcake', 'pie', 'bread', 'pretzel'),
    'coffee': ('coffee_shop', 'coffee', 'cafe', 'tea', 'bubble_tea', 'boba', 'juice', 'smoothie', 'smoothies', 'açaí', 'acai'),
    'dessert': ('ice_cream', 'gelato', 'frozen_yogurt', 'dessert', 'desserts', 'candy', 'chocolate', 'custard', 'shaved_ice', 'crepe_dessert'),
    'mexican': ('mexican', 'tex-mex', 'tex_mex', 'tacos', 'taco', 'burrito', 'latin_american', 'latin', 'colombian', 'salvadoran', 'dominican', 'brazilian', 'peruvian', 'cuban', 'caribbean', 'jamaican', 'puerto_rican', 'venezuelan', 'argentinian', 'honduran', 'guatemalan', 'ecuadorian', 'chilean'),
    'chinese': ('chinese', 'cantonese', 'szechuan', 'sichuan', 'dim_sum', 'hot_pot', 'hotpot', 'dumpling', 'dumplings'),
    'japanese': ('japanese', 'sushi', 'ramen', 'izakaya', 'teppanyaki', 'yakitori', 'hibachi'),
    'thai': ('thai',),
    'korean': ('korean',),
    'vietnamese': ('vietnamese', 'pho'),
    'indian': ('indian', 'pakistani', 'punjabi', 'south_indian', 'curry', 'bangladeshi'),
    'asian': ('asian', 'noodle', 'noodles', 'filipino', 'malaysian', 'indonesian', 'mongolian', 'taiwanese', 'nepalese', 'tibetan', 'burmese', 'cambodian', 'laotian'),
    'mediterranean': ('mediterranean', 'greek', 'turkish', 'middle_eastern', 'lebanese', 'falafel', 'kebab', 'shawarma', 'israeli', 'persian', 'iranian', 'moroccan', 'syrian', 'armenian', 'afghan', 'spanish', 'tapas', 'portuguese', 'gyros', 'gyro'),
    'french': ('french', 'crepe', 'crepes', 'creperie', 'patisserie'),
    'barbecue': ('barbecue', 'bbq', 'smokehouse'),
    'steak': ('steak_house', 'steakhouse', 'steak'),
    'chicken': ('chicken', 'fried_chicken', 'wings', 'chicken_wings', 'rotisserie'),
    'salad': ('salad', 'salads', 'poke', 'hawaiian', 'healthy', 'soup', 'bowls'),
    'vegetarian': ('vegetarian', 'vegan', 'plant_based'),
    'pub': ('pub', 'gastropub', 'bar_and_grill', 'irish', 'german', 'beer', 'brewpub', 'tavern'),
}

#: A room inside something.
ROOM_NAME = "\\b(program|meeting|community|conference|reading|storyhour|story|activity|multi-?purpose|craft|computer|quiet|study|board|history|children'?s|teen|youth services|lower level|upper level)\\s+room\\b|\\broom\\s*\\d|\\bannex\\b|\\bauditorium\\b|\\bclassroom\\b|\\bgymnasium\\b|\\b(lower|upper|ground|first|second|third|fourth)\\s+(level|floor)\\b"
#: Placeholders for a venue, normalised.
NOT_A_VENUE = (
    'google meet', 'home', 'n/a', 'no room needed', 'off site', 'offsite', 'online', 'see listing', 'tba', 'tbd', 'to be announced', 'unknown',
    'various', 'various locations', 'virtual', 'virtual event', 'virtual meeting', 'virtual no room needed', 'virtual program', 'zoom',
)
#: A street corner.
CROSSROADS = '\\b(st|street|ave|avenue|rd|road|blvd|drive|dr|way|place|pl)\\b[^&]*&|&[^&]*\\b(st|street|ave|avenue|rd|road|blvd|drive|dr)\\b'
#: Towns that are no venue.
BARE_TOWNS = (
    'beacon', 'bronx', 'brooklyn', 'catskill', 'cold spring', 'connecticut', 'danbury', 'hudson', 'hudson valley', 'kingston', 'manhattan',
    'millerton', 'new jersey', 'new paltz', 'new york', 'newburgh', 'nyack', 'nyc', 'peekskill', 'poughkeepsie', 'queens', 'rhinebeck',
    'stamford', 'upstate', 'westchester', 'woodstock',
)
#: Words that say nothing in a title.
TITLE_STOP_WORDS = (
    'a', 'an', 'and', 'annual', 'at', 'featuring', 'for', 'in', 'of', 'on', 'presents', 'the', 'to', 'with',
)
#: Entities and escapes that a better reading would have removed.
UNCLEAN = '&(?:amp|lt|gt|quot|nbsp|#\\d+|#x[0-9a-f]+);|\\\\[nrt\\\'"]'
#: Older type names to today's.
TYPE_ALIASES = {
    'theater': 'play',
    'creative': 'class',
    'art': 'art exhibit',
    'science': 'talk',
    'sports': 'sporting event',
    'wellness': 'yoga',
    'outdoors': 'tour',
    'open-mic': 'open mic',
    'food': 'dinner',
    'comedy': 'comedy show',
    'dating': 'speed dating',
    'kids': 'other',
    'show': 'play',
    'music': 'concert',
    'community': 'meetup',
    'nightlife': 'party',
    'family': 'other',
    'meetup': 'club',
    'exhibit': 'museum exhibit',
    'museum': 'museum exhibit',
}
#: Place kind that an event type implies.
KIND_FROM_TYPE = {
    'concert': 'music venue',
    'dj': 'music venue',
    'open mic': 'music venue',
    'play': 'theatre',
    'musical': 'theatre',
    'film': 'cinema',
    'comedy show': 'theatre',
    'dance': 'theatre',
    'museum exhibit': 'museum',
    'art exhibit': 'gallery',
    'sporting event': 'stadium',
    'religious ceremony': 'place of worship',
    'tasting': 'brewery',
    'animal encounter': 'park',
}
#: Words that say what kind of place, not which (knowledge items).
ITEM_GENERIC = (
    'and', 'art', 'arts', 'avenue', 'brewery', 'brewing', 'brook', 'building', 'cafe', 'center', 'centre', 'church', 'cinema', 'city', 'company',
    'connecticut', 'county', 'district', 'east', 'farm', 'farms', 'forest', 'gallery', 'garden', 'gardens', 'hall', 'hampshire', 'hill',
    'historic', 'historical', 'house', 'island', 'jersey', 'lake', 'library', 'light', 'lighthouse', 'maine', 'massachusetts', 'memorial',
    'mount', 'mountain', 'museum', 'national', 'new', 'north', 'park', 'pond', 'public', 'reservation', 'restaurant', 'rhode', 'river', 'road',
    'school', 'shop', 'site', 'society', 'south', 'state', 'station', 'store', 'street', 'the', 'theater', 'theatre', 'town', 'vermont',
    'village', 'vineyard', 'vineyards', 'west', 'winery', 'york',
)
#: Words that say what kind of place, not which (ratings).
NAME_GENERIC = (
    'and', 'bakery', 'bar', 'cafe', 'coffee', 'company', 'corner', 'diner', 'family', 'food', 'foods', 'grill', 'house', 'kitchen', 'main',
    'pizza', 'pizzeria', 'pub', 'restaurant', 'shop', 'street', 'tavern', 'the', 'village',
)
#: Descriptions of settlements.
SETTLEMENT_TEXT = '^(village|town|city|hamlet|census-designated place|county|neighbou?rhood|unincorporated community|human settlement|borough|township)\\b'
#: Regions that end the title of a settlement.
STATES = (
    'New York', 'Connecticut', 'Massachusetts', 'Maine', 'New Hampshire', 'Vermont', 'Rhode Island', 'New Jersey', 'Pennsylvania', 'Quebec',
    'New Brunswick',
)

#: Meetings of committees.
NOISE = '\\b(board meeting|planning meeting|committee meeting|staff meeting|agm|annual general meeting)\\b'
#: Closed or cancelled.
CLOSURE = '^\\s*\\[closed\\]|^\\s*closed(?!-)\\s*(?:$|[-–—:(]|for\\b|to the public|all day|on\\b|in observance|until\\b)|\\b(?:library|office|building|branch|museum|center|centre|cottage|gallery|park)\\s+clos(?:ed|ing)\\b|\\bclosed\\s+(?:to the public|all day|in observance|for\\s+(?:a\\s+)?private\\b)|\\bclosing\\s+(?:early\\b|at\\s+\\d)|^[\\s\\[(*]*(?:event\\s+)?cancell?ed\\s*(?:$|[-–—:)\\]*]|from\\b|for\\b|due\\b)|\\*{2,}\\s*cancell?ed\\b'
#: A school's own calendar.
SCHOOL_INTERNAL = '\\b(first|last) day of (school|classes)\\b|\\bschool (opens|closes|begins|resumes)\\b|\\bsemester (begins|ends)\\b|\\bclasses (begin|resume|end)\\b|\\bno school\\b|\\bearly dismissal\\b|\\bsnow day\\b|\\bhalf[- ]day\\b|\\b(parent|student)[- ]teacher conference|\\breport cards?\\b|\\bpta\\b|\\bpto meeting\\b|\\bschool board\\b|\\bsuperintendent\\b|\\b(kindergarten|freshman|new student|student) orientation\\b|\\bback[- ]to[- ]school night\\b|\\bcourse (registration|selection)\\b|\\bfinal exams? (week|period)\\b|\\bgraduation rehearsal\\b|\\bconvocation\\b'
#: For students of a campus.
STUDENT_ONLY = '\\b(orientation|welcome (week|weekend|back|tables?|to)|viking days|move[- ]in|first day of class|last day of class|no classes|classes (resume|begin)|registration|add/drop|advising|final exams?|finals|cram jam|reading day|convocation|commencement|open house|info(rmation)? session|undergraduate visit|campus tour|admitted student|prospective student|enrollment|study abroad|career fair|job fair|resource fair|involvement fair|resume|internship|alumni|reunion|homecoming|sorority|fraternity|greek life|student (employment|involvement|organization|activities|government|meet)|clubs? carnival|common hour|campus community)\\b'
#: On a campus, for anyone.
CAMPUS_PUBLIC = '\\b(concert|recital|symphony|orchestra|choir|jazz|open mic|lecture|talk|reading|author|poet|keynote|symposium|panel|gallery|exhibit\\w*|opening reception|film|screening|theat(er|re)|musical|comedy|festival|streetfest|craft fair|farmers? market|mass|worship|memorial|vigil|5k|10k|run/walk|marathon|blood drive|book club|family day|map-a-thon|planetarium)\\b'
#: Sports.
SPORT = '\\b(basketball|soccer|volleyball|baseball|softball|hockey|lacrosse|tennis|golf|swimming|diving|cross country|field hockey|football|rugby)\\b'
#: A home game.
HOME_GAME = '\\bvs\\.?\\b'
#: An away game; with regard to case.
AWAY_GAME = '\\b(?:at|@)\\s+[A-Z]'

#: Words of a title that stay small.
MINOR_WORDS = ("a", "an", "and", "as", "at", "but", "by", "for", "from", "in", "into", "nor", "of", "on", "or", "the", "to", "up", "vs", "with")

#: Hosts whose pages tell no price or refuse to be read. Fixed values.
PRICELESS_HOSTS = ("ticketmaster.com", "ticketweb.com", "songkick.com", "meetup.com")

#: What makes a map element a destination. Fixed values.
THIN_KINDS = ("historic site", "historic house", "garden", "park", "landmark", "lookout")
VISITABLE_GARDENS = ("botanical", "arboretum")
PUBLIC_LAND = ("State Park", "State Forest", "State Historic Site", "Wild Forest", "Wildlife Management Area", "Wildlife Sanctuary", "Nature Preserve", "Multiple Use Area", "Unique Area", "County Park", "National Park", "National Wildlife Refuge", "National Historic Site")
LINEAR_TAGS = ("highway", "railway", "route", "waterway")
VISIT_SIGNALS = ("website", "contact:website", "url", "opening_hours", "tourism", "wikipedia", "description", "fee", "access")
FOOD_SIGNALS = ("cuisine", "website", "contact:website", "opening_hours", "phone", "contact:phone")
CHAIN_TAGS = ("brand", "brand:wikidata", "operator:brand")
WEBSITE_TAGS = ("website", "contact:website", "url", "website:official")
