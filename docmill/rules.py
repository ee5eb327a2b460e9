"""Dimension data: dictionaries, rules, templates, selector rules.

Everything here is plain data. Operators take these as parameters, so a
caller can pass its own dictionary; the defaults below are the fixed values
whose outputs must equal the behaviour being rebuilt.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Ingestion format dispatch.
# Exact content-type match first; otherwise the file extension.
CONTENT_TYPE_KIND = [
    ("text/plain", "text"),
    ("text/markdown", "text"),
    ("application/json", "json"),
    ("text/html", "html"),
    ("application/pdf", "pdf"),
]
EXTENSION_KIND = [
    ("txt", "text"),
    ("md", "text"),
    ("json", "json"),
    ("html", "html"),
    ("pdf", "pdf"),
]
DEFAULT_KIND = "text"
# Upload filters: documents accept these extensions, the target page html.
DOCUMENT_EXTENSIONS = ["md", "txt", "json", "pdf"]
PAGE_EXTENSIONS = ["html"]
MAX_DOCUMENT_BYTES = 10 * 1024 * 1024  # advisory size per document

# ---------------------------------------------------------------------------
# Feature keyword dictionary (order = output order).
FEATURE_KEYWORDS = [
    ("discount_code", ["discount", "coupon", "promo", "save15"]),
    ("cart", ["cart", "add to cart", "quantity", "item"]),
    ("shipping", ["shipping", "delivery", "standard", "express"]),
    ("payment", ["payment", "credit card", "paypal", "pay now"]),
    ("form_validation", ["validation", "error", "required", "email"]),
    ("user_details", ["name", "email", "address", "user"]),
]

# Specification rules, in order. All needles must occur; they
# are compared with the lower-cased context except when case_sensitive.
# (feature, [(needle, case_sensitive)...], specification)
SPEC_RULES = [
    ("discount_code", [("save15", False), ("15%", False)], "SAVE15 code applies 15% discount"),
    ("discount_code", [("discount", False)], "Discount code functionality available"),
    ("shipping", [("express", False), ("$10", True)], "Express shipping costs $10"),
    ("shipping", [("standard", False), ("free", False)], "Standard shipping is free"),
    ("form_validation", [("red", False), ("error", False)], "Error messages displayed in red"),
    ("form_validation", [("required", False)], "Required field validation"),
    ("payment", [("green", False), ("pay now", False)], "Pay Now button should be green"),
]

# Test-case templates, in emission order per feature
# (positive before negative). (feature_key, test_type, feature, scenario,
# expected_result, steps)
TEST_TEMPLATES = [
    ("discount_code", "positive", "Discount Code", "Apply valid discount code SAVE15",
     "Total price is reduced by 15%",
     ["Add items to cart", "Navigate to checkout", 'Enter discount code "SAVE15"', "Click apply",
      "Verify 15% discount is applied"]),
    ("cart", "positive", "Shopping Cart", "Add items to cart and update quantities",
     "Cart updates correctly with new quantities and totals",
     ['Click "Add to Cart" for multiple items', "Verify items appear in cart", "Update item quantities",
      "Verify total price updates correctly"]),
    ("form_validation", "positive", "Form Validation", "Submit form with valid data",
     "Form submits successfully without errors",
     ["Fill all required fields with valid data", "Enter valid email format", "Click submit",
      "Verify successful submission"]),
    ("discount_code", "negative", "Discount Code", "Apply invalid discount code",
     "Error message displayed, no discount applied",
     ["Add items to cart", "Navigate to checkout", 'Enter invalid discount code "INVALID"', "Click apply",
      "Verify error message appears"]),
    ("form_validation", "negative", "Form Validation", "Submit form with invalid email",
     "Email validation error displayed in red",
     ["Fill form with invalid email format", "Click submit", "Verify red error message for email field"]),
    ("form_validation", "negative", "Form Validation", "Submit form with empty required fields",
     "Required field errors displayed",
     ["Leave required fields empty", "Click submit", "Verify required field error messages"]),
]

# Fallback rows.
GENERIC_CASE = {
    "feature": "General Functionality",
    "scenario_prefix": "Test functionality related to: ",
    "expected_result": "System behaves according to documentation specifications",
    "test_type": "exploratory",
    "steps": ["Review relevant documentation", "Identify key functionality to test",
              "Execute test scenarios", "Verify expected behavior"],
}
EMPTY_RETRIEVAL_CASE = {
    "test_id": "TC-001",
    "feature": "General",
    "test_scenario": "No relevant documentation found",
    "expected_result": "Please upload relevant documentation first",
    "grounded_in": "No source",
    "test_type": "informational",
}
SOURCE_TAG_PATTERN = r"\[Source: ([^\]]+)\]"

# Prompt for batch test-case generation ({query}, {context}).
TEST_CASE_PROMPT = '''
You are a senior QA engineer. Use ONLY the documentation provided below to
create detailed UI test cases for the user request.

User request:
"""{query}"""

Documentation context:
"""{context}"""

Respond with pure JSON: an array of test case objects.
Each object must include the keys: test_id, feature, test_scenario,
expected_result, grounded_in, test_type (positive|negative|exploratory), steps.
The steps value must be an ordered list of actionable steps.
Use concise wording and reference the documents you relied on in grounded_in.
'''

# ---------------------------------------------------------------------------
# Selector slots (CSS, comma = OR; first match in document order).
SELECTOR_RULES = [
    ("add_to_cart_buttons", 'button[onclick*="addToCart"], .add-to-cart'),
    ("cart_items", ".cart-item, .item"),
    ("quantity_inputs", 'input[type="number"], input[name*="quantity"]'),
    ("discount_input", 'input[name*="discount"], input[id*="discount"], #discountCode'),
    ("apply_discount_btn", 'button[onclick*="discount"], #applyDiscount'),
    ("name_input", 'input[name="name"], #name, input[placeholder*="name"]'),
    ("email_input", 'input[name="email"], #email, input[type="email"]'),
    ("address_input", 'input[name="address"], #address, textarea[name="address"]'),
    ("shipping_options", 'input[name="shipping"], input[type="radio"][value*="shipping"]'),
    ("payment_options", 'input[name="payment"], input[type="radio"][value*="payment"]'),
    ("pay_button", 'button[onclick*="pay"], #payNow'),
    ("total_price", ".total, #total, .price-total"),
    ("error_messages", ".error, .error-message, .validation-error"),
]
# A button whose lower-cased text contains this replaces the pay_button rule.
PAY_BUTTON_TEXT = "pay now"
PAY_BUTTON_SLOT = "pay_button"
# Key sections: div/section whose class matches this pattern.
KEY_SECTION_TAGS = ["div", "section"]
KEY_SECTION_CLASS = r"cart|checkout|payment|form|total"
KEY_SECTION_PREVIEW = 100
FORM_FIELD_TAGS = ["input", "select", "textarea"]

# ---------------------------------------------------------------------------
# Script families, routed on lower(feature), first match wins.
SCRIPT_FAMILIES = [
    ("discount", ["discount"]),
    ("cart", ["cart", "shopping"]),
    ("form", ["form", "validation"]),
    ("payment", ["payment"]),
]
GENERIC_FAMILY = "generic"
# Slots each family reads, with the default used when the page
# has no match. (family, slot, default)
FAMILY_SLOT_DEFAULTS = [
    ("discount", "discount_input", "#discountCode"),
    ("discount", "apply_discount_btn", "#applyDiscount"),
    ("discount", "total_price", ".total"),
    ("discount", "add_to_cart_buttons", "button"),
    ("discount", "error_messages", ".error"),
    ("form", "name_input", '[name="name"]'),
    ("form", "email_input", '[name="email"]'),
    ("form", "address_input", '[name="address"]'),
    ("form", "pay_button", 'button[type="submit"]'),
    ("form", "error_messages", ".error"),
    ("cart", "add_to_cart_buttons", "button"),
    ("cart", "cart_items", ".cart-item"),
    ("cart", "quantity_inputs", 'input[type="number"]'),
    ("cart", "total_price", ".total"),
    ("payment", "payment_options", 'input[name="payment"]'),
    ("payment", "name_input", '[name="name"]'),
    ("payment", "email_input", '[name="email"]'),
    ("payment", "pay_button", "#payNow"),
    ("generic", "add_to_cart_buttons", "button"),
    ("generic", "name_input", '[name="name"]'),
    ("generic", "email_input", '[name="email"]'),
]

# Slots that only one branch of a family uses (the others are
# used by both branches).
BRANCH_SLOTS = [
    ("discount", "total_price", "positive"),
    ("discount", "error_messages", "negative"),
    ("form", "address_input", "positive"),
]

# Components a generated script must contain (case-insensitive).
REQUIRED_SCRIPT_COMPONENTS = [
    "import",
    "selenium",
    "webdriver",
    "class Test",
    "def setup",
    "def teardown",
    "def test_",
    'if __name__ == "__main__"',
]

# ---------------------------------------------------------------------------
# Checkout arithmetic.
DISCOUNT_CODES = [("SAVE15", 0.15)]
SHIPPING_COSTS = [("standard", 0.0), ("express", 10.0)]
# White space is JavaScript's (the class also parses in RE2).
EMAIL_PATTERN = r"^[^@{ws}]+@[^@{ws}]+\.[^@{ws}]+$".replace("{ws}", (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"))
DISCOUNT_TOLERANCE = 0.01

# Prompt for script generation. Placeholders are filled per
# (test case, page); {selectors} and {structure} are indent-2 JSON, {steps}
# the list as Python prints it.
SCRIPT_PROMPT = '''
You are a senior QA automation engineer. Generate a complete, production-ready Selenium Python script based on the test case and HTML structure provided.

TEST CASE DETAILS:
- Test ID: {test_id}
- Feature: {feature}
- Scenario: {test_scenario}
- Expected Result: {expected_result}
- Test Type: {test_type}
- Steps: {steps}

AVAILABLE SELECTORS:
{selectors}

HTML STRUCTURE ANALYSIS:
{structure}

PROJECT DOCUMENTATION CONTEXT:
{context}

REQUIREMENTS:
1. Generate a complete Python class with proper imports
2. Include setup() method with Chrome WebDriver configuration (headless mode)
3. Include teardown() method for cleanup
4. Create specific test methods based on the test case steps
5. Use explicit waits (WebDriverWait) and proper error handling
6. Include assertions that verify the expected results
7. Add meaningful comments explaining each step
8. Use the most reliable selectors from the provided options (prefer ID > name > class > CSS)
9. Handle edge cases and potential timing issues with time.sleep() when needed
10. Include a run_test() method to execute all tests
11. Make the script executable with proper if __name__ == "__main__" block
12. Use try-except blocks for robust error handling
13. Include print statements for test progress and results (✓ for pass, ✗ for fail)
14. For discount tests: calculate expected totals and verify percentage discounts
15. For form validation: check for error messages and their styling (color)
16. For cart tests: verify item counts and total calculations
17. Update the file path in setup() to use a relative path like "file:///path/to/checkout.html"

SCRIPT STRUCTURE EXAMPLE:
```python
class Test{class_suffix}:
    def __init__(self):
        self.driver = None
        self.wait = None
    
    def setup(self):
        # Chrome driver setup with headless mode
        
    def test_main_functionality(self):
        # Main test logic based on test case steps
        
    def teardown(self):
        # Cleanup
        
    def run_test(self):
        # Execute all tests with proper error handling
```

Generate ONLY the Python script code, no explanations or markdown formatting. Ensure the script is syntactically correct and executable.
'''
