"""Rule tables and word lists as data. The values are fixed: they must equal the published lists for equal results."""

from weftwork.operators.rules import Rule

NOISE_V3 = ("what was i doing", "step away", "continue the order", "reorder", "re-order", "same thing i ordered", "last week", "last weekend")
NOISE_V4 = ("what was i doing", "step away", "continue the order", "reorder", "re order", "same thing i ordered", "last week", "last weekend", "again")
UNSUPPORTED = ("pizza", "pizz", "burger", "hamburger", "burrito", "hot dog", "sandwich", "sandwiches", "poke", "sushi", "gyro", "gyros", "greek", "mexican", "indian", "thai", "italian", "barbecue", "bbq", "taco", "tacos")
TRIVIAL = ("no thanks", "no it s okay", "no it is okay", "okay", "yes", "no", "that s all", "that is all", "thank you", "thanks", "sure", "correct", "alright", "all right", "no thank you", "no that s it", "no that is it", "that s it", "that is it")
WORD_COUNT_STOP = ("hi", "hello", "hey", "please", "okay", "ok", "thanks", "thank", "you")

#: First match wins. keep None: kept where the row is of the ordering domain.
CANDIDATE_RULES = (
    Rule("off_scope_reservation", ("reserve", "reservation", "book a table", "book me a table", "book a spot", "table for ", "party of ", "seating for "), keep=False, reason="reservation_request_out_of_scope"),
    Rule("off_scope_payment", ("credit card", "debit card", "cash", "apple pay", "google pay", "pay with", "payment", "visa", "mastercard", "tip"), keep=False, reason="payment_flow_out_of_scope"),
    Rule("off_scope_delivery_address", ("deliver to", "delivery address", "my address", "to my house", "to my apartment", "what's the address", "where are you located", "where is it located", "directions", "near me", "nearby", "zip code"), keep=False, reason="delivery_or_address_request_out_of_scope"),
    Rule("ask_allergy", ("allergy", "allergic", "gluten", "peanut", "nut", "dairy", "shellfish", "vegan", "vegetarian")),
    Rule("ask_ingredient", ("what's in", "what is in", "what are the ingredients", "ingredient", "come with", "comes with", "made of", "does that have")),
    Rule("ask_price", ("how much", "what's the price", "what is the price", "what does it cost", "price of", "cost of"), keep=None, reason="restaurant_search_price_query_not_selected"),
    Rule("ask_menu", ("what do you have", "what kind of", "menu", "sides", "drinks", "desserts", "options", "what comes"), keep=None, reason="restaurant_search_menu_query_not_selected"),
    Rule("ask_recommendation", ("recommend", "recommended", "popular", "best", "suggest", "favorite", "specialty"), keep=None, reason="restaurant_search_recommendation_not_selected"),
    Rule("remove_item", ("remove", "take off", "take that off", "cancel", "delete", "hold the ", "without ", "no onions", "no tomatoes"), keep=None, reason="non_food_remove_request_not_selected"),
    Rule("modify_order", ("change", "instead", "make that", "switch that", "with ranch", "extra ", "add ", "make it ", "substitute"), keep=None, reason="non_food_modify_request_not_selected"),
    Rule("confirm_order", ("that's all", "that'll do", "that will do", "sounds great", "sounds good", "correct", "yes that's right", "confirm", "that is correct"), keep=None, reason="restaurant_search_confirmation_not_selected"),
    Rule("order_item", ("can i get", "could i get", "i'd like", "i would like", "i want", "i'll have", "i will have", "order", "for takeout", "to go"), keep=None, reason="restaurant_search_order_like_text_not_selected"),
)
CANDIDATE_DEFAULT = Rule("unclear", keep=False, reason="unclear_for_menu_grounded_adaptation")

#: High-precision requests on text normalised as v4; without a match the row goes.
STRICT_RULES = (
    Rule("ask_menu", patterns=(r"\bmenu\b", r"\bwhat do you have\b", r"\bwhat are the options\b", r"\bwhat can i order\b")),
    Rule("ask_price", patterns=(r"\bhow much\b", r"\bcost\b", r"\bprice\b", r"\btotal\b", r"\bcharge\b"), unless=("price range", "price rating", "moderate", "location", "spend a ton")),
    Rule("ask_ingredient", ("what is in", "what s in", "ingredients", "comes with", "does it include", "contains")),
    Rule("ask_allergy", ("allergy", "allergic", "gluten", "dairy", "peanut allergy", "nut allergy", "contains nuts", "without nuts because allergy")),
    Rule("modify_order", patterns=(r"\bwithout\s+\w+", r"\bno\s+\w+", r"\bextra\s+\w+", r"\badd\s+\w+", r"\bremove\s+\w+", r"\bhold\s+\w+", r"\binstead of\b")),
    Rule("modify_order", patterns=(r"\bwith\s+\w+",), needs=("i want", "i would like", "i will have", "i ll have", "can i get", "could i get", "order", "get me", "make that", "i need")),
    Rule("confirm_order", patterns=(r"\bconfirm\b", r"\bis that all\b", r"\bthat s it\b", r"\bthat is it\b", r"\bcorrect\b")),
)

#: Reply cascade over folded text: intents that need no mention, in order.
REPLY_BEFORE_MENTION = (
    Rule("greeting", ("merhaba", "selam", "iyi gunler")),
    Rule("thanks", ("tesekkur", "sag olun")),
    Rule("ask_hours", ("kacta aciliyorsunuz", "kacta kapaniyorsunuz", "calisma saatleriniz", "calisma saatleri", "kacta acik", "kacta kapaniyor", "saat kacta acik", "saat kacta kapaniyor")),
    Rule("restaurant_info", ("restoranin adi", "restoran adi", "mekanin adi", "restoranin ismi", "adiniz ne", "kart geciyor", "kredi karti geciyor", "odeme secenekleri", "odeme yontemleri", "temassiz", "paket servis", "teslimat", "kurye", "adres", "nerede", "konum")),
    Rule("recommendation", patterns=(r"(?:^|\s)(?:oner|tavsiye)",)),
    Rule("ask_categories", ("kategori", "menude neler var", "menunuzde neler var", "menu neler", "menunuz neler", "menude ne var", "menunuzde ne var", "menu secenekleri")),
    Rule("allergy", ("alerji", "glutensiz", "laktoz", "sut urunu", "sut urunleri", "dairy", "findik", "fistik", "gluten")),
    Rule("confirm_order", ("onayliyorum", "siparisi onayla", "siparisimi onayla", "evet onayla", "evet dogru", "bu siparis dogru", "siparisimi ver")),
    Rule("summary", ("ozet", "toplam", "siparisim ne")),
    Rule("clear_order", ("temizle", "tumunu iptal")),
    Rule("remove_order", ("iptal", "cikar", "sil")),
)
ADD_WORDS = r"\b(?:istiyorum|alabilir|siparis|ekle|isterim|alayim)\b"
NUMBER = r"\b(?:\d+|bir|iki|uc|dort|bes)\b"
NUMBER_WORDS = {"bir": 1, "iki": 2, "uc": 3, "dort": 4, "bes": 5}
PRICE_ASKS = ("fiyat", "ne kadar", "kac tl", "fiyati ne")
INGREDIENT_ASKS = ("icerik", "icinde ne var", "hangi malzeme", "hangi malzemelerle", "hazirlaniyor")
DETAIL_ASKS = ("fiyat", "icerik", "icinde", "nedir")
INFO_TOPICS = (
    Rule("name", ("restoranin adi", "restoran adi", "mekanin adi", "restoranin ismi", "adiniz ne")),
    Rule("payment", ("kart geciyor", "kredi karti geciyor", "odeme secenekleri", "odeme yontemleri", "temassiz")),
    Rule("allergen_policy", ("alerjen bilgisi",), needs=("guvenilir", "dogru", "teyit", "emin")),
    Rule("vegetarian", ("vejetaryen",), needs=("secenek",)),
    Rule("delivery", ("paket servis", "teslimat", "kurye")),
    Rule("location", ("adres", "nerede", "konum")),
)

# The category that aliases stand for, its aliases (folded), marks of restaurant facts, and grounded intents.
MAIN_DISH = "ana yemek"
MAIN_DISH_ALIASES = ("ana yemek", "ana yemekler", "yemek", "yemekler", "yemekleri")
INFO_MARKERS = ("10:00", "22:00", "nakit", "kredi kartı", "temassız ödeme", "teyit", "Vejetaryen", "demo")
GROUNDED_INTENTS = ("greeting", "restaurant_info", "menu_question", "recommendation", "price_question", "allergen_question", "add_item", "remove_item", "clear_order", "summarize_order", "confirm_order", "unavailable_item", "off_topic")
